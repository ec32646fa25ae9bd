"""Quality classification by importance resampling.

Two generative models over hashed n-grams (words and signs, and their pairs, in
``BUCKETS`` buckets): one of target text (labelled of good quality), one of the
raw text (all documents). A document's log importance weight is the sum of the
log ratios of its n-grams; Gumbel noise added to it makes "take the k largest"
a sample of k documents without replacement in proportion to the weights.

Counts run over every document and are summed per task before they shuffle; the
model is ``BUCKETS`` numbers whatever the corpus. The k-th largest key is found
by counting in ever finer intervals, so nothing is sorted or sent to the driver
but counts and one interval of at most ``EXACT_ROWS`` keys.

The noise is a function of the row (hash of id and text) and a seed.

Defined results: a null text counts as empty; a text without n-grams has weight
0. Rows tied at the threshold (rows equal in id and text) all stay. Labels of
held-out rows (crc32(doc_id as text) mod 4 = 2) are never read. Without target
rows the target model is the raw one. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.common import stage
from quire.llm.splitting import WordCache

BUCKETS, SMOOTHING, EXACT_ROWS, BINS = 10_000, 1.0, 10_000, 4096
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_U = np.uint64
_HASHES = WordCache(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words], 200_000)


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of a text."""
    tokens = _TOKEN.findall((text or "").lower())
    h = np.fromiter(map(_HASHES.fill(tokens), tokens), _U, len(tokens))
    pairs = (h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:]) * _U(0xC2B2AE3D27D4EB4F)
    return (np.concatenate([h, pairs ^ (pairs >> _U(29))]) % _U(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, whether it counts as raw text, as target) -> (bucket, raw, target)."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, every, good in zip(*(c.to_pylist() for c in batch.columns)):
            n = np.bincount(buckets(text), minlength=BUCKETS)
            if every:
                raw += n
            if good:
                target += n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    p, q = ((n + SMOOTHING) / (n.sum() + SMOOTHING * len(n)) for n in (target.astype(float), raw.astype(float)))
    return np.log(p) - np.log(q)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the share of good rows among the labelled training rows (1 without any)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_qi_good"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    n, good = known.agg(F.count(F.lit(1)), F.sum("_qi_good")).first()
    known = known.where("_qi_good = 1").select(F.col("doc_id").alias("_qi_id"), F.lit(True).alias("_qi_target"))
    rows = docs.select(F.col(id_col).alias("_qi_doc"), F.col(text_col).alias("text"))
    if n <= common.BROADCAST_LABELS:
        rows = rows.join(F.broadcast(known), F.col("_qi_doc") == F.col("_qi_id"), "left").select("text", F.lit(True).alias("raw"), "_qi_target")
    else:  # all texts once for the raw model, and those labelled good again
        good_rows = common.labelled(rows, known, F.col("_qi_doc"), "_qi_id", n).select("text", F.lit(False).alias("raw"), "_qi_target")
        rows = rows.select("text", F.lit(True).alias("raw"), F.lit(False).alias("_qi_target")).unionByName(good_rows)
    counts = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).orderBy("bucket").toPandas()  # BUCKETS rows
    raw, target = (counts[c].to_numpy() if len(counts) else np.zeros(BUCKETS) for c in ("raw", "target"))
    return log_ratios(raw, target), good / n if n else 1.0


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_grams, log_weight, key`` of each document."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            found = [buckets(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(b) for b in found], pa.int64()), pa.array([float(table[b].sum()) for b in found], pa.float64())], ["doc_id", "noise", "n_grams", "log_weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("noise"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, noise long, n_grams long, log_weight double")
    u = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return out.withColumn("key", F.col("log_weight") - F.log(-F.log(u))).drop("noise")


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of ``col`` (no nulls), by counting in ever finer intervals."""
    low, high, rank = *df.agg(F.min(col), F.max(col)).first(), k
    while True:
        # the wanted value is the rank-th largest in [low, high]
        inside = df.where((F.col(col) >= low) & (F.col(col) <= high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low or inside.count() <= EXACT_ROWS:
            top = inside.select(col).orderBy(F.desc(col)).limit(rank).collect() if width > 0 and low + width != low else []
            return top[-1][0] if top else low
        at = F.least(F.floor((F.col(col) - low) / width), F.lit(BINS - 1))
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(at).agg(F.count(F.lit(1)), F.min(col), F.max(col)).collect()}  # at most BINS rows
        for b in sorted(counts, reverse=True):
            n, low, high = counts[b]
            if n >= rank:
                break
            rank -= n


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, n_grams, log_weight, key, kept``.

    ``share`` of the documents stay; by default the share of good rows among
    the labelled ones.
    """
    ratios, good = fit(docs, labels)
    rows = stage(weigh(docs, ratios, seed), "importance")
    n = rows.count()
    k = round(n * (good if share is None else share))
    if not k:
        return rows.withColumn("kept", F.lit(False))
    return rows.withColumn("kept", F.col("key") >= kth_largest(rows, "key", k))
