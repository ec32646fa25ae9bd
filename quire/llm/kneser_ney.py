"""Class-conditional Kneser-Ney models over the characters of words.

Two classes share one backoff. For a character c after the up to ``HISTORY``
characters h of its word (the word's start counts as one):

    p_k(c | h) = (n_k(hc) - D(n_k(hc)) + M_k(h) * q(c | h2)) / n_k(h)

with class counts n_k, discounts D for counts of one, two and more, M_k(h) the
sum of what h's continuations lose in class k, and q the Kneser-Ney
continuation model of the last two characters h2, counted over both classes
together; so an expression that neither class has seen often gets much the same
value from both. Where class k never saw h, p_k = q. The long history tells
apart words whose parts are common; what a class saw once counts for little.

Counts live in a table with a row for each distinct n-gram that was met, however
many there are. An n-gram is named by ``context``, a 64-bit mix of its history
(any two of N histories get the same one with a probability of about N^2 /
2^65), and ``tri``, its last three characters, 21 bits each. ``Models`` holds
the table in memory; ``toxicity.SlicedModels`` is for larger ones.
"""

from __future__ import annotations

import numpy as np

#: How many characters the smoothing of the lowest order reckons with.
CODES = 1 << 16
HISTORY, DISCOUNTS, SHARED_DISCOUNT = 7, (0.0, 0.9, 1.4, 1.8), 0.75
CODE_BITS = 21
#: Words that are scored at once: some hundred bytes for each of their characters.
WORDS = 4000
_CODE = (1 << CODE_BITS) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(words: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each character (and end) of each word: the word's number and its n-gram's ``context`` and ``tri``."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes)) - first[word]
    back = []
    for k in range(1, HISTORY + 1):
        p = np.zeros_like(codes)
        p[k:] = codes[:-k]
        p[at < k] = 0
        back.append(p)
    live = at > 0
    code, word = codes[live], word[live]
    a, b, *rest = (p[live] for p in back)
    pair = (b << np.uint64(CODE_BITS)) | a
    context = _mix(pair ^ np.uint64(1 << 50))
    for p in rest:
        context = _mix(context * np.uint64(0x9E3779B97F4A7C15) + p)
    return word, {"context": context.view(np.int64), "tri": ((pair << np.uint64(CODE_BITS)) | code).view(np.int64)}


def merge(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row for each distinct (context, tri), with the sums of ``toxic`` and ``ordinary``."""
    if not len(rows["tri"]):
        return rows
    order = np.lexsort((rows["tri"], rows["context"]))
    context, tri = rows["context"][order], rows["tri"][order]
    first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (tri[1:] != tri[:-1])])
    return {"context": context[first], "tri": tri[first]} | {k: np.add.reduceat(rows[k][order], first) for k in ("toxic", "ordinary")}


def count(words: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the words' distinct n-grams: ``context``, ``tri``, ``toxic`` and ``ordinary``."""
    word, s = grams(words)
    return merge(s | {"toxic": toxic[word].astype(np.int64), "ordinary": ordinary[word].astype(np.int64)})


def discount(n: np.ndarray) -> np.ndarray:
    return np.array(DISCOUNTS, np.float32)[np.minimum(n, 3).astype(np.int64)]


def _find(keys: np.ndarray, asked: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """For each value table, what it holds for ``asked`` in the sorted ``keys``; 0 for keys that aren't there."""
    if not len(keys):
        return [np.zeros(len(asked), v.dtype) for v in values]
    asked, places = np.unique(asked, return_inverse=True)  # in order, a search walks through memory once
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return [np.where(hit, v[at], 0)[places] for v in values]


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


class Endings:
    """The lowest order: how many different three-character endings each character has, of ``kinds`` in all."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, kinds: int):
        self.codes, self.ends, self.kinds = codes, ends.astype(np.float32), kinds

    def low(self, tri: np.ndarray) -> np.ndarray:
        return (_find(self.codes, tri & _CODE, self.ends)[0].astype(np.float64) + 0.1) / (self.kinds + 0.1 * CODES)


class Shared:
    """The continuation model of the last two characters, or the part of it that some of them need.

    ``tris`` in order, ``counts``: in how many contexts each ends.
    """

    def __init__(self, tris: np.ndarray, counts: np.ndarray):
        self.tris, self.counts = tris, counts.astype(np.float32)
        first = _starts(tris >> CODE_BITS)
        self.pairs = (tris >> CODE_BITS)[first]
        self.follow = np.diff(np.r_[first, len(tris)]).astype(np.float32)
        self.total = np.add.reduceat(self.counts, first).astype(np.float32) if len(first) else np.zeros(0, np.float32)

    def fill(self, q: np.ndarray, tri: np.ndarray) -> None:
        """Put the smoothed value of each character in place of its lowest order, where its last two are known here."""
        (n3,) = _find(self.tris, tri, self.counts)
        n2, follow = _find(self.pairs, tri >> CODE_BITS, self.total, self.follow)
        known = n2 > 0
        q[known] = (np.maximum(n3 - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * follow * q)[known] / n2[known]


class Contexts:
    """Both classes' counts after each context, or after some of them; ``rows`` is used up."""

    def __init__(self, rows: dict[str, np.ndarray]):
        context, tri = (np.asarray(rows.pop(k), np.int64) for k in ("context", "tri"))
        counts = [np.asarray(rows.pop(k), np.float32) for k in ("toxic", "ordinary")]
        if len(context) and not ((context[1:] > context[:-1]) | (context[1:] == context[:-1]) & (tri[1:] > tri[:-1])).all():
            order = np.lexsort((tri, context))
            context, tri, counts = context[order], tri[order], [n[order] for n in counts]
        first = _starts(context)
        self.contexts = context[first]
        del context
        self.number = np.arange(len(first), dtype=np.int32)
        # a context's number and a character: no two n-grams share it, and within a context the last three characters rise with the last
        self.keys = np.repeat(self.number, np.diff(np.r_[first, len(tri)])).astype(np.int64)
        self.keys <<= CODE_BITS
        self.keys |= tri & _CODE
        sums = lambda x: np.add.reduceat(x, first, dtype=np.float64).astype(np.float32) if len(first) else np.zeros(0, np.float32)
        self.classes = [(n, sums(n), sums(discount(n))) for n in counts]

    def values(self, context: np.ndarray, tri: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log p_toxic - log p_ordinary of each character; 0 after a context that is not held here."""
        number, *sums = _find(self.contexts, context, self.number, *(x for _, *both in self.classes for x in both))
        counts = _find(self.keys, (number.astype(np.int64) << CODE_BITS) | (tri & _CODE), *(c[0] for c in self.classes))
        logs = []
        for seen, n, mass in zip(counts, sums[::2], sums[1::2]):
            p = (np.where(n > 0, seen - discount(seen), 0) + mass * q) / np.maximum(n, 1)
            logs.append(np.log(np.maximum(np.where(n > 0, p, q), 1e-12)))
        return logs[0] - logs[1]


class Models:
    """Both classes' models from a table of n-gram counts (one row for each distinct n-gram)."""

    def __init__(self, rows: dict[str, np.ndarray]):
        """``rows`` is used up; rows in order of (context, tri) are not sorted again."""
        tris = np.sort(np.asarray(rows["tri"], np.int64))
        first = _starts(tris)
        counts, tris = np.diff(np.r_[first, len(tris)]), tris[first]
        self.shared = Shared(tris, counts)
        self.endings = Endings(*np.unique(tris & _CODE, return_counts=True), len(tris))
        del tris, counts, first
        self.known = Contexts(rows)

    def ratios(self, words: list[str]) -> np.ndarray:
        """log p_toxic(word) - log p_ordinary(word)."""
        if len(words) > WORDS:
            return np.concatenate([self.ratios(words[k : k + WORDS]) for k in range(0, len(words), WORDS)])
        if not words:
            return np.zeros(0, np.float32)
        word, s = grams(words)
        q = self.endings.low(s["tri"])
        self.shared.fill(q, s["tri"])
        return np.bincount(word, self.known.values(s["context"], s["tri"], q), len(words)).astype(np.float32)
