"""Toxicity by class-conditional Kneser-Ney models (see ``kneser_ney``).

Learning, over all labelled training rows but those of the fit: words are counted by class
(pre-aggregated in each task, then summed by word), the words' n-grams by class
likewise, and the table of distinct n-grams that results is written out: it
follows the corpus. Up to ``BROADCAST_GRAMS`` n-grams it is broadcast and words
are scored once per worker and looked up after that; a larger one stays a table,
and the distinct words of the texts are scored in passes over slices of it: the
texts are written in chunks, each chunk's distinct words meet their scores, and
the task that scores a chunk reads its dictionary from the shared folder. Both
give the same.

Scoring: the difference of a text's two log-likelihoods, normalised by length,
over the whole text, over its most telling word and over the three most telling
(a few toxic words hardly move the mean over a long text: by that alone, held-out
recall at sf0.1 is 46 of 120 instead of 113); a logistic function of these three
differences, fitted on a further part of the training rows (at most
``CALIBRATION_ROWS``, chosen by hash), gives the score.

Training rows are those whose crc32(doc_id as text) mod 4 is not 2. Those with
remainder 3 that the fit takes give no counts, all others do; rows with
remainder 2 are held out and their labels never read.

Defined results: null text counts as empty. A text without words has all
features 0 and so the score of no evidence. Several labels of one document: the
largest. A null doc_id is never a training row and never held out. Without
training rows of both classes every score is the share of toxic rows (0 if
there are none). Extra columns pass through ``score_documents``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow.fs import FileSelector
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import kneser_ney
from quire.llm.common import drop, give_back, labelled, open_fs, shared_path, sized, stage, trimmed
from quire.llm.splitting import WordCache

THRESHOLD = 0.3
CALIBRATION_ROWS = 20_000
#: Models of up to this many distinct n-grams are broadcast (about 30 bytes each); larger ones are gone through in slices.
BROADCAST_GRAMS = 1 << 22
_HELD_WORDS = 200_000
_HELD_GRAMS = 250_000
_WORD = re.compile(r"\w+")
FEATURES = ["_qt_all", "_qt_best", "_qt_top"]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def fold(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 4; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (word, toxic, ordinary), summed within the task as far as memory allows."""

    def out():
        words = list({**held[0], **held[1]})
        return pa.RecordBatch.from_arrays([pa.array(words), *(pa.array([held[k][w] for w in words], pa.int64()) for k in (1, 0))], ["word", "toxic", "ordinary"])

    held = [Counter(), Counter()]
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[1 if toxic else 0].update(words_of(text))
            if len(held[0]) + len(held[1]) > _HELD_WORDS:
                yield out()
                held = [Counter(), Counter()]
    yield out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return kneser_ney.merge({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})

    parts: list[dict[str, np.ndarray]] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            parts.append(kneser_ney.count(part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy()))
            if sum(len(p["tri"]) for p in parts) > 3 * _HELD_GRAMS:
                rows = merged(parts)
                parts = [rows]
                if len(rows["tri"]) > 2 * _HELD_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[k]) for k in rows], list(rows))
                    parts = []
    if parts:
        rows = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(rows[k]) for k in rows], list(rows))


def hashes(words: list[str]) -> np.ndarray:
    """64 bits that stand for a word where words are joined."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, text) -> (chunk, word, h): each chunk's distinct words, as far as a task's memory allows."""

    def out():
        words = list(held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk, np.int32)), pa.array(words, pa.string()), pa.array(hashes(words))], ["chunk", "word", "h"])

    held, chunk = set(), None
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for c, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if held and (c != chunk or len(held) > _HELD_WORDS):
                    yield out()
                    held = set()
                chunk = c
                held.update(words_of(text))
    if held:
        yield out()


class Dictionary:
    """The ratios of a chunk's words, from the shared folder."""

    def __init__(self, folder: str, chunk: int):
        fs, path = open_fs(f"{folder}/chunk={chunk}")
        files = [i.path for i in fs.get_file_info(FileSelector(path, allow_not_found=True)) if i.path.endswith(".parquet")]
        tables = [pq.read_table(fs.open_input_file(f), columns=["h", "ratio"]) for f in files]
        columns = [np.concatenate([np.zeros(0, t), *(x.column(c).to_numpy() for x in tables)]) for c, t in (("h", np.int64), ("ratio", np.float32))]
        self.keys, first = np.unique(columns[0], return_index=True)
        self.values = columns[1][first]

    def ratios(self, words: list[str]) -> np.ndarray:
        return self.values[np.searchsorted(self.keys, hashes(words))] if words else np.zeros(0, np.float32)


class SlicedModels:
    """The models of ``kneser_ney.Models`` for any number of n-grams (a staged table, used up): slices that fit in memory, gone through one after the other.

    Words are scored in passes: first the shared model of each character, by
    slices of the last two characters; then what the classes make of it, by
    slices of contexts. A pass reads and writes the distinct words, and nothing
    but them; a slice is broadcast and holds about ``BROADCAST_GRAMS`` n-grams.
    """

    def __init__(self, grams: DataFrame, count: int):
        tris = stage(grams.groupBy("tri").agg(F.count(F.lit(1)).alias("n3")), "toxicity-tris")
        kinds = tris.count()
        self.contexts, self.context_slices = self._sliced(grams, F.col("context"), count)
        self.tris, self.tri_slices = self._sliced(tris, F.shiftright("tri", kneser_ney.CODE_BITS), kinds)
        drop(grams)
        code = F.col("tri").bitwiseAND(F.lit((1 << kneser_ney.CODE_BITS) - 1))
        codes = tris.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("ends")).orderBy("code").toArrow()  # at most as many as Unicode has
        self.endings = kneser_ney.Endings(codes.column("code").to_numpy(), codes.column("ends").to_numpy(), kinds)
        drop(tris)

    @staticmethod
    def _sliced(rows: DataFrame, key: Column, count: int) -> tuple[DataFrame, int]:
        """``rows`` written by slice, and how many slices there are."""
        n = sized(count, max(1, BROADCAST_GRAMS))
        path = shared_path(rows.sparkSession, "toxicity-slices")
        rows.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition("slice").write.partitionBy("slice").parquet(path)
        return rows.sparkSession.read.parquet(path), n

    def ratios(self, words: DataFrame) -> DataFrame:
        """The distinct ``words`` (word, h) with their ``value``, log p_toxic - log p_ordinary; a staged table."""
        spark = words.sparkSession
        held = words.select("word", "h", F.lit(None).cast("binary").alias("q"), F.lit(0.0).alias("value"))
        last = None
        steps = [(True, k) for k in range(self.tri_slices)] + [(False, k) for k in range(self.context_slices)]
        for shared, k in steps:
            if shared:
                rows = self.tris.where(F.col("slice") == k).select("tri", F.col("n3").cast("float")).orderBy("tri").toArrow()
                part = kneser_ney.Shared(rows.column("tri").to_numpy(), rows.column("n3").to_numpy())
            else:
                part = _contexts(self.contexts.where(F.col("slice") == k))
            done = stage(held.mapInArrow(_pass(spark.sparkContext.broadcast((self.endings, part)), shared), "word string, h long, q binary, value double"), "toxicity-pass")
            if last is not None:
                drop(last)
            held = last = done
        return held


def _contexts(grams: DataFrame) -> kneser_ney.Contexts:
    columns = _collected(grams)
    return kneser_ney.Contexts(columns)


def _collected(grams: DataFrame) -> dict[str, np.ndarray]:
    """The columns of up to ``BROADCAST_GRAMS`` n-grams, in order."""
    table = grams.select("context", "tri", F.col("toxic").cast("float"), F.col("ordinary").cast("float")).orderBy("context", "tri").toArrow()
    columns = {k: table.column(k).to_numpy() for k in table.column_names}
    del table
    give_back()
    return columns


def _pass(held: Broadcast, shared: bool):
    """Over (word, h, q, value): fill what a slice knows of each character's shared value, or add what it knows of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings, part = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                rows = batch.slice(at, 4000)
                words, packed = rows.column(0).to_pylist(), rows.column(2).to_pylist()
                word, s = kneser_ney.grams(words)
                q = endings.low(s["tri"]) if packed[0] is None else np.frombuffer(b"".join(packed), np.float32).astype(np.float64)
                value = rows.column(3).to_numpy()
                if shared:
                    part.fill(q, s["tri"])
                    ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
                    raw = q.astype(np.float32).tobytes()
                    packed = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
                else:
                    value = value + np.bincount(word, part.values(s["context"], s["tri"], q), len(words))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(packed, pa.binary()), pa.array(value)], ["word", "h", "q", "value"])

    return run


class Toxicity:
    """Fitted models and the weights that turn features into a score."""

    def __init__(self, models: kneser_ney.Models | SlicedModels, weights: list[float]):
        self.models, self.weights = models, weights

    def __getstate__(self):
        return {"models": self.models, "weights": self.weights}

    def features(self, texts: list[str | None]) -> np.ndarray:
        if "cache" not in self.__dict__:
            self.cache = WordCache(lambda words: self.models.ratios(words).tolist(), 120_000)
        out = np.zeros((len(texts), len(FEATURES)))
        split = list(map(words_of, texts))
        get = self.cache.fill(chain.from_iterable(split))
        for i, words in enumerate(split):
            if not words:
                continue
            v = np.fromiter(map(get, words), np.float32, len(words))
            n = np.fromiter(map(len, words), np.float32, len(words)) + 1
            each = v / n
            k = min(3, len(words))
            out[i] = v.sum(dtype=np.float64) / n.sum(dtype=np.float64), each.max(), np.partition(v, -k)[-k:].mean() / 10
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 50) -> list[float]:
    """Intercept and weights by Newton's method; the penalty keeps them finite where classes separate."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3, *[penalty] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _with_features(df: DataFrame, text_col: str, model: Toxicity) -> DataFrame:
    if isinstance(model.models, SlicedModels):
        return _with_dictionaries(df, text_col, model.models)
    at = df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                x = held.value.features(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x[:, j]) for j in range(len(FEATURES)))], [*part.schema.names, *FEATURES])

    return df.mapInArrow(lambda batches: trimmed(run(batches)), T.StructType([*df.schema.fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES)]))


def _with_dictionaries(df: DataFrame, text_col: str, models: SlicedModels) -> DataFrame:
    """The rows are written in chunks (one of each task); a chunk's distinct words meet their ratios, and each chunk gets a dictionary."""
    spark = df.sparkSession
    rows = stage(df.withColumn("_qt_chunk", F.spark_partition_id()), "toxicity-rows")
    words = stage(rows.select("_qt_chunk", text_col).mapInArrow(_chunk_words, "chunk int, word string, h long"), "toxicity-words")
    distinct = stage(words.select("word", "h").distinct(), "toxicity-distinct")
    ratios = models.ratios(distinct)
    drop(distinct)
    folder = shared_path(spark, "toxicity-dictionaries")
    words.select("chunk", "h").join(ratios.select("h", F.col("value").cast("float").alias("ratio")), "h").repartition("chunk").write.partitionBy("chunk").parquet(folder)
    drop(words, ratios)
    names, at, chunk_at = df.columns, rows.columns.index(text_col), rows.columns.index("_qt_chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Toxicity] | None = None
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                chunks = part.column(chunk_at).to_numpy()
                x = np.zeros((part.num_rows, len(FEATURES)))
                for c in np.unique(chunks).tolist():
                    if held is None or held[0] != c:
                        held = c, Toxicity(Dictionary(folder, c), [])
                    mine = np.flatnonzero(chunks == c)
                    x[mine] = held[1].features(part.column(at).take(pa.array(mine)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], [*names, *FEATURES])

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), T.StructType([*df.schema.fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES)]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Learn from the labelled rows of ``docs`` that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_qt_toxic"))
    known = known.select(F.col("doc_id").alias("_qt_id"), "_qt_toxic", fold().alias("_qt_fold")).where("_qt_fold <> 2")
    n = known.count()
    rows = docs.select(F.col(id_col).alias("_qt_doc"), F.col(text_col).alias("text"))
    train = labelled(rows, known, F.col("_qt_doc"), "_qt_id", n)
    every = max(1, -(-n // (4 * CALIBRATION_ROWS)))
    for_fit = (F.col("_qt_fold") == 3) & (F.pmod(F.xxhash64("_qt_id"), F.lit(every)) == 0)
    words = train.where(~for_fit).select("text", "_qt_toxic").mapInArrow(_count_words, "word string, toxic long, ordinary long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    grams = words.mapInArrow(_count_grams, "context long, tri long, toxic long, ordinary long")
    grams = stage(grams.groupBy("context", "tri").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxicity-grams")
    count = grams.count()
    if count <= BROADCAST_GRAMS:
        models = kneser_ney.Models(_collected(grams))
        give_back()
    else:
        models = SlicedModels(grams, count)
    model = Toxicity(models, [])

    sample = train.where(for_fit).select("text", "_qt_toxic")
    got = _with_features(sample, "text", model).select("_qt_toxic", *FEATURES).toArrow()
    x = np.column_stack([got.column(f).to_numpy() for f in FEATURES]) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got.column("_qt_toxic").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if 0 < y.sum() < len(y):
        model.weights = fit_logistic(x, y)
    else:
        share = float(y.mean()) if len(y) else 0.0
        model.weights = [float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), *[0.0] * len(FEATURES)]
    return model


def score_documents(docs: DataFrame, model: Toxicity, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1) as the further column ``out``."""
    scored = _with_features(docs, text_col, model)
    z = F.lit(model.weights[0])
    for name, w in zip(FEATURES, model.weights[1:]):
        z = z + F.col(name) * w
    return scored.withColumn(out, 1 / (1 + F.exp(-z))).drop(*FEATURES)
