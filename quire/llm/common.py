"""Shared plumbing of the training-data operators: staging, numbering, file access.

Intermediate data that more than one job reads is written as Parquet below the
folder named by ``spark.checkpoint.dir`` (the one place that the driver and all
executors share), so lineage is cut there and a lost executor only costs a
re-read.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.storage import shared_root

#: Rows that a task should hold at most when a window or a Python group needs them together.
GROUP_ROWS = 50_000
#: Sums of pieces up to this many (about 100 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_SUMS = 200_000
#: Narrow tables (some numbers a row) up to this many rows are broadcast, larger ones joined by shuffle.
BROADCAST_ROWS = 500_000
#: Labels up to this count are broadcast (about 50 bytes a row); of more, a filter of this many 64-bit words is.
BROADCAST_LABELS, LABEL_WORDS = 1_000_000, 1 << 20


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is removed at the end; what stays must have been written by ``kept``."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            remove(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``stage``, for a result that outlives ``scratch``."""
    token = _SCRATCH.set(None)
    try:
        return stage(df, name)
    finally:
        _SCRATCH.reset(token)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged, narrow), broadcast if its count allows."""
    return F.broadcast(df) if df.count() <= most else df


def labelled(docs: DataFrame, known: DataFrame, key: Column, known_key: str, count: int) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``known`` (``count`` rows, keys not null), with its columns.

    Beyond ``BROADCAST_LABELS`` rows, a filter with a bit for each key is
    broadcast, and only documents that it lets through shuffle.
    """
    if count <= BROADCAST_LABELS:
        return docs.join(F.broadcast(known), key == F.col(known_key))
    word = lambda k: F.xxhash64(k.cast("string")).bitwiseAND(F.lit(LABEL_WORDS - 1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(k.cast("string")), 58).cast("int"))
    bits = stage(known.groupBy(word(F.col(known_key)).alias("_ql_word")).agg(F.bit_or(bit(F.col(known_key))).alias("_ql_bits")), "label-filter")
    may = docs.join(F.broadcast(bits), word(key) == F.col("_ql_word")).where(F.col("_ql_bits").bitwiseAND(bit(key)) != 0).drop("_ql_word", "_ql_bits")
    return may.join(known, key == F.col(known_key))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more (those given must be ``stage``'s own results)."""
    for df in staged:
        for file in df.inputFiles()[:1]:
            remove(df.sparkSession, file.rpartition("/")[0])


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: its worker lives on, and counts as its executor's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def trimmed(batches: Iterator) -> Iterator:
    """The batches, with ``give_back`` after the last."""
    yield from batches
    give_back()


def give_back_heaps(spark: SparkSession) -> None:
    """Executors' JVMs collect their garbage and return free heap to the system.

    A JVM keeps what heap it once touched, so an executor's memory would be the
    sum of its largest stage and its largest workers, whenever each was. One
    task a core reaches the executors that are idle; no result depends on it.
    """
    cores = spark.sparkContext.defaultParallelism
    try:
        spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()
    except AnalysisException:  # where a session allows no reflection
        return


def open_fs(uri: str):
    """(pyarrow file system, path in it) for a URI; works in the driver and in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(rows: int, per: int = GROUP_ROWS, least: int = 1) -> int:
    """How many pieces of about ``per`` rows ``rows`` make."""
    return max(least, -(-rows // per))


def cut(key: Column, pieces: int) -> Column:
    """Piece 0 .. pieces-1 of a row, by hash of ``key``; no key can fill a piece alone unless its rows are equal."""
    return F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int")


def piece_sums(df: DataFrame, group: list[str], piece: str, value: Column) -> DataFrame:
    """The sum ``_qn_s`` of each (group, piece), staged."""
    return stage(df.groupBy(*group, piece).agg(F.sum(value.cast("long")).alias("_qn_s")), "piece-sums")


def numbered(df: DataFrame, group: list[str], order: list[str], piece: str, out: str, value: Column | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` (default 1) within ``group``, in order of (``piece``, ``order``).

    The window runs within (group, piece) only; what the pieces before hold is
    added from a table of sums per piece. So no group, however large, lies in
    one task, as long as ``piece`` divides it.
    """
    v = F.lit(1).cast("long") if value is None else value.cast("long")
    sums = piece_sums(df, group, piece, v) if sums is None else sums
    df = df.withColumn("_qn_v", v)
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.select(*[F.col(g).alias(f"_qn_{i}") for i, g in enumerate([*group, piece])], F.coalesce(F.sum("_qn_s").over(before), F.lit(0)).alias("_qn_base")), "sums")
    if sums.count() <= BROADCAST_SUMS:
        sums = F.broadcast(sums)
    within = Window.partitionBy(*group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_qn_in", F.coalesce(F.sum("_qn_v").over(within), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_qn_{i}")) for i, g in enumerate([*group, piece])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(sums, cond, "left").withColumn(out, F.col("_qn_base") + F.col("_qn_in")).drop("_qn_v", "_qn_in", "_qn_base", *[f"_qn_{i}" for i in range(len(group) + 1)])
