"""Fast pre-tokenisation that agrees with the tokenizer files' own rules.

The rules' character classes depend on the Unicode version of the library that
applies them. ``PLAIN`` texts hold only characters on which those rules and
Python's ``re`` agree (a test compares them one by one with the library); every
other text is left to the library.
"""

from __future__ import annotations

import re
import unicodedata

_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-˿‐-‧‰-⁞]")
_SHORT = r"'(?:[stmd]|re|ve|ll)"


def plain(text: str) -> bool:
    return text.isascii() and not re.search("[\x1c-\x1f]", text) or not _OTHER.search(text)


def _listed(kind: str) -> str:
    """The plain characters that are letters (L), numbers (N) or signs (S), as explicit ranges: faster than negated classes."""
    name = lambda c: "" if c.isspace() else k if (k := unicodedata.category(c)[0]) in "LN" else "S"
    plain_chars = [c for c in map(chr, range(0x2100)) if not _OTHER.match(c)]
    chars = sorted(c for c in {*plain_chars, *(low for c in plain_chars for low in c.lower())} if name(c) == kind)
    runs: list[list[str]] = []
    for c in chars:
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in runs)


_LETTER, _NUMBER, _SIGN = map(_listed, "LNS")
#: With the space before a word kept as part of it; white space is kept.
BYTE_WORDS = re.compile(rf" ?[{_LETTER}]+|{_SHORT}| ?[{_NUMBER}]+| ?[{_SIGN}]+|\s+(?!\S)|\s+")
#: White space dropped, numbers digit by digit; for lower-cased text.
LOWER_WORDS = re.compile(rf"[{_LETTER}]+|{_SHORT}|[{_NUMBER}]|[{_SIGN}]+")


class WordCache:
    """Word -> what ``make`` gives for a list of missing words; two generations bound its size.

    A worker process runs one task at a time and serves many stages, so only
    the cache in use keeps its words.
    """

    in_use: WordCache | None = None

    def __init__(self, make, most: int = 200_000):
        self.make, self.most, self.table, self.old = make, most, {}, {}

    def fill(self, words):
        """A look-up that knows every one of ``words``; valid until the next call."""
        if WordCache.in_use is not self:
            if WordCache.in_use is not None:
                WordCache.in_use.table, WordCache.in_use.old = {}, {}
            WordCache.in_use = self
        words = set(words)
        missing = words.difference(self.table)  # a plain dict: each word is looked up, the table isn't walked
        if missing and len(self.table) + len(missing) > self.most:
            self.old, self.table = self.table, {}
            missing = words
        if missing:
            old = self.old
            again = [w for w in missing if w in old]
            for w in again:
                self.table[w] = old[w]
            new = list(missing.difference(again))
            self.table.update(zip(new, self.make(new)))
        return self.table.__getitem__
