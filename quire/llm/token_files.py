"""Token-id files in patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream, cut into blocks of
``BLOCK`` ids. A block subtracts its minimum, packs the differences at the
width that ``PERCENTILE`` of them need, and keeps the few larger ones apart as
exceptions (position and full difference). An index of block starts at the
file's end allows reading any document by itself.

Layout, little endian: ``QTK1``; the blocks, each ``u32 minimum, u8 width, u16
exceptions, packed differences, u16 positions, u32 differences``; the index:
``u64`` offset of each block, then per document ``u8 has id, i64 id, u64
tokens``; the foot: ``u64 index offset, u64 blocks, u64 documents, u64 tokens``.

Files are written by tasks that each hold one range of doc_id, to a temporary
name and then moved, so a task run again replaces its file by an equal one.

Defined results: null text counts as empty and gives only the end id; equal
doc_ids are ordered by a hash of their texts, so that ranges can part them, too;
a null doc_id sorts first and stays null. Other columns are not read. An empty
table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import byte_alphabet
from quire.llm.common import open_fs, sized
from quire.llm.splitting import LOWER_WORDS, WordCache, plain

BLOCK, PERCENTILE, MAGIC = 1024, 90, b"QTK1"
_HEAD, _FOOT, _DOC = struct.Struct("<IBH"), struct.Struct("<QQQQ"), np.dtype([("has", "u1"), ("id", "<i8"), ("n", "<u8")])
#: Blocks that a reader holds at once.
READ_BLOCKS = 512


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a stream; the last may be short and is padded with its minimum."""
    n = -(-len(ids) // BLOCK)
    full = np.zeros(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    if len(ids) % BLOCK:
        full[len(ids) :] = full[(n - 1) * BLOCK : len(ids)].min()
    rows = full.reshape(n, BLOCK)
    low = rows.min(axis=1)
    gap = rows - low[:, None]
    at = BLOCK * PERCENTILE // 100 - 1
    width = np.ceil(np.log2(np.partition(gap, at, axis=1)[:, at].astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * n
    for w in map(int, np.unique(width)):
        for sel in np.array_split(np.flatnonzero(width == w), max(1, (width == w).sum() // 64)):
            g = gap[sel]
            over = g >= (1 << w)
            packed = _pack(np.where(over, 0, g), w)
            for k, b in enumerate(sel):
                where = np.flatnonzero(over[k])
                out[b] = _HEAD.pack(int(low[b]), w, len(where)) + packed[k].tobytes() + where.astype("<u2").tobytes() + g[k][where].astype("<u4").tobytes()
    return out


def _unit(w: int) -> int:
    """The bits of the smallest integer type that holds ``w``."""
    return 8 if w <= 8 else 16 if w <= 16 else 32


def _pack(rows: np.ndarray, w: int) -> np.ndarray:
    """Each row's values as ``w`` bits each, as bytes."""
    u = _unit(w)
    raw = rows.astype(f"<u{u // 8}").view(np.uint8)
    if w == u:
        return raw
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), -1, u)[:, :, :w]
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def unpack_block(block: bytes) -> np.ndarray:
    low, w, n = _HEAD.unpack_from(block)
    end = _HEAD.size + w * BLOCK // 8
    u, raw = _unit(w), np.frombuffer(block, np.uint8, end - _HEAD.size, _HEAD.size)
    if w != u:
        bits = np.zeros((BLOCK, u), np.uint8)
        bits[:, :w] = np.unpackbits(raw, bitorder="little").reshape(BLOCK, w)
        raw = np.packbits(bits, bitorder="little")
    gap = raw.view(f"<u{u // 8}").astype(np.uint32)
    if n:
        gap[np.frombuffer(block, "<u2", n, end)] = np.frombuffer(block, "<u4", n, end + 2 * n)
    return gap + np.uint32(low)


class TokenFileWriter:
    """Streams documents into one file; holds at most ``READ_BLOCKS`` blocks of ids and the index."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.sink.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= READ_BLOCKS * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.held]).astype(np.uint32)
        upto = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in pack_blocks(ids[:upto]) if upto else ():
            self.starts.append(self.at)
            self.sink.write(block)
            self.at += len(block)
        self.tokens += upto
        self.held, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array(self.docs, _DOC).tobytes())
        self.sink.write(_FOOT.pack(self.at, len(self.starts), len(self.docs), self.tokens))
        self.sink.close()


class TokenFile:
    """Reads a file by its index; ``source`` is a seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _FOOT.size)
        self.index_at, blocks, docs, self.tokens = _FOOT.unpack(source.read(_FOOT.size))
        source.seek(self.index_at)
        rest = source.read(size - _FOOT.size - self.index_at)
        self.starts = np.append(np.frombuffer(rest, "<u8", blocks), np.uint64(self.index_at)).astype(np.int64)
        self.docs = np.frombuffer(rest, _DOC, docs, 8 * blocks)
        self.begin = np.concatenate([[0], np.cumsum(self.docs["n"].astype(np.int64))])

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the stream; reads only their blocks."""
        if first >= end:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        self.source.seek(int(self.starts[a]))
        raw, base = self.source.read(int(self.starts[b] - self.starts[a])), int(self.starts[a])
        blocks = [unpack_block(raw[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]) for k in range(a, b)]
        return np.concatenate(blocks)[first - a * BLOCK : end - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.begin[k]), int(self.begin[k + 1]))

    def batches(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids), about ``READ_BLOCKS`` blocks at a time."""
        k, n = 0, len(self.docs)
        while k < n:
            e = max(k + 1, int(np.searchsorted(self.begin, self.begin[k] + READ_BLOCKS * BLOCK, "right")) - 1)
            yield k, e, self.ids(int(self.begin[k]), int(self.begin[e]))
            k = e


class LowerWordEncoder:
    """The library's encoding of a lower-casing word vocabulary, with each distinct word encoded once.

    Words are encoded apart from one another by such a tokenizer, so a text's
    ids are its words' ids in turn, and its model needs no splitting for one
    word. Texts beyond plain characters, and those that hold a special token's
    string, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        model, alphabet = self.lib.model, {b: c for c, b in byte_alphabet().items()}
        of = lambda w: w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(alphabet)
        self.words = WordCache(lambda words: [array("I", [t.id for t in model.tokenize(of(w))]).tobytes() for w in words], 450_000)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [LOWER_WORDS.findall(t.lower()) if plain(t) and not any(s in t for s in self.special) else None for t in texts]
        get = self.words.fill(chain.from_iterable(filter(None, split)))
        return [b"".join(map(get, words)) if words is not None else np.array(self.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, words in zip(texts, split)]


@lru_cache(maxsize=2)
def lower_word_encoder(path: str) -> LowerWordEncoder:
    return LowerWordEncoder(path)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 8192) -> list[tuple[str, int, int]]:
    """Write ``docs`` in ascending order of id; gives (file, documents, tokens) in that order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = min(20_000, sized(docs.count(), rows_per_file, 2))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer = lower_word_encoder(vocabulary), np.array([end_id], np.uint32), None
        part = TaskContext.get().partitionId()
        fs, path = open_fs(f"{folder}/part-{part:06d}.qtk")
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                    if writer is None:
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        writer = TokenFileWriter(fs.open_output_stream(temporary))
                    writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), end))
        if writer is not None:
            writer.close()
            fs.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"part-{part:06d}.qtk"]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.tokens], pa.int64())], ["part", "file", "docs", "tokens"])

    done = rows.mapInArrow(write, "part int, file string, docs long, tokens long").collect()  # a row a file
    return [(r["file"], r["docs"], r["tokens"]) for r in sorted(done, key=lambda r: r["part"])]


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids`` (packed unsigned 32-bit)."""
    base, todo = 0, []
    for name, _, tokens in files:
        todo.append((name, base))
        base += tokens
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = open_fs(f"{folder}/{name}")
                with fs.open_input_file(path) as source:
                    held = TokenFile(source, source.size())
                    for a, b, ids in held.batches():
                        docs, raw, begin = held.docs[a:b], ids.astype("<u4").tobytes(), held.begin[a : b + 1]
                        cuts = (begin - begin[0]).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(docs["id"].astype(np.int64), mask=docs["has"] == 0),
                                pa.array(begin[:-1] + start),
                                pa.array(docs["n"].astype(np.int64)),
                                pa.array([raw[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:])], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    if not todo:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(todo, "file string, base long").repartition(len(todo), "file").mapInArrow(read, schema)
