"""Byte-level BPE encoding and decoding over a contiguous rank array.

A word is held as one list of its parts and one list of the ranks of adjacent
parts. The encoder repeatedly scans the ranks for the minimum, deletes the
boundary there and refreshes the ranks of the two neighbouring pairs. Scanning
a short contiguous list is cheaper than any queue; words above ``SHORT`` bytes
(unbroken runs) take a heap over a linked list instead, with the same result
in n log n steps.

Defined results: null text counts as empty and gives no ids. The special
token's own string inside a text becomes its id. Texts of any length are
encoded whole. Ids outside the vocabulary decode to nothing; byte sequences
that are not UTF-8 decode to U+FFFD. Ids of rows may be null or repeat; an empty
table gives an empty result; other columns are read only where ``keep`` names them.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import trimmed
from quire.llm.splitting import BYTE_WORDS, WordCache, plain

SHORT = 256
_NONE = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary file's merges; ``encode`` gives packed little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in vocab}
        self.of_byte = [0] * 256
        for t, b in raw.items():
            if len(b) == 1:
                self.of_byte[b[0]] = vocab[t]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {vocab[t]: b for t, b in raw.items()} | {i: s.encode() for s, i in self.special.items()}
        self.words = WordCache(lambda words: [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.word, (w.encode() for w in words))])
        self.path = path

    def word(self, b: bytes) -> list[int]:
        parts = [self.of_byte[x] for x in b]
        if len(parts) > SHORT:
            return self._long(parts)
        get = self.rank.get
        ranks = [get(x << 20 | y, _NONE) for x, y in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], _NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue  # one of the two has been merged since
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r2 := get(parts[k] << 20 | parts[after[k]])) is not None:
                    heapq.heappush(heap, (r2, k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    @property
    def library(self):
        if "lib" not in self.__dict__:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(self.path)
        return self.lib

    def split(self, text: str) -> list[str]:
        if plain(text):
            return BYTE_WORDS.findall(text)
        chars = byte_alphabet()
        return [bytes(chars[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = list(map(self.pieces, texts))
        get = self.words.fill(chain.from_iterable(w for pieces in split for w in pieces if type(w) is list))
        return [b"".join([b"".join(map(get, w)) if type(w) is list else struct.pack("<I", self.special[w]) for w in pieces]) for pieces in split]

    def pieces(self, text: str) -> list[list[str] | str]:
        """Lists of words, and between them the special tokens' strings."""
        if not any(s in text for s in self.special):
            return [self.split(text)]
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return [p if i % 2 else self.split(p) for i, p in enumerate(parts)]

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process and file."""
    return ByteBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per document: ``doc_id, n_tokens, ids`` (packed unsigned 32-bit), ``decoded`` (from those ids) and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string()), *part.columns[2:]], ["doc_id", "n_tokens", "ids", "decoded", *keep])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    types = dict(rows.dtypes)
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), ", ".join([f"doc_id {types['doc_id']}, n_tokens long, ids binary, decoded string", *(f"`{k}` {types[k]}" for k in keep)]))
