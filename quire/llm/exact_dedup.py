"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Texts are read once, for a narrow table of hashes. Each hash names a 64-bit word
of a filter and two bits in it. Pass one counts the rows of each (word, bits)
and keeps those that more than one row set; the filter follows the table, with
``BITS_PER_ROW`` bits a row, and what is kept of it follows the repeated texts, so
it never fills up. Pass two tests each row against the bits kept: a row whose
bits aren't all there surely has no copy and passes straight through; only
possible repeats shuffle, and without their texts. False positives cost a little
shuffling and never change a result, as the groups are then formed by SHA-256.

What is kept of the filter is broadcast up to ``BROADCAST_WORDS`` words; beyond
that, hashes (no texts) meet it by a shuffle. Likewise the list of rows that go.

Defined results: null text counts as empty; texts are equal when identical
after lower-casing A-Z only. The largest ``doc_id`` of a group stays; a null
id loses against any other. Rows equal in text and id are copies of one
another and one of them stays. An empty table gives an empty result. Other
columns aren't read by ``duplicate_marks`` and pass through ``exact_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, small, stage

BITS_PER_ROW, MIN_WORDS = 32, 1 << 10
#: Words of the filter, and rows of the list of those that go, that are broadcast (two numbers each).
BROADCAST_WORDS = 1 << 20
HOT_GROUPS = 1000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null gives ''."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def filter_words(rows: int) -> int:
    """Words of the filter for so many rows: a power of two."""
    want = max(MIN_WORDS, rows * BITS_PER_ROW // 64)
    return 1 << (want - 1).bit_length()


def _word_and_bits(h: Column, words: int) -> tuple[Column, Column]:
    """The word of a hash, and two different bits of it from the hash's other end."""
    one = F.shiftrightunsigned(h, 58)
    two = (one + 1 + F.pmod(F.shiftrightunsigned(h, 48), F.lit(63))).bitwiseAND(F.lit(63))
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))
    return h.bitwiseAND(F.lit(words - 1)), bit(one).bitwiseOR(bit(two))


def repeated_bits(hashes: DataFrame, h: str, words: int) -> DataFrame:
    """Pass one: ``(_qb_word, _qb_set)``, the bits that more than one row set together."""
    word, bits = _word_and_bits(F.col(h), words)
    again = hashes.groupBy(word.alias("_qb_word"), bits.alias("_qb_bits")).count().where("count > 1")
    return again.groupBy("_qb_word").agg(F.bit_or("_qb_bits").alias("_qb_set"))


def possible_repeats(df: DataFrame, h: str, repeated: DataFrame, words: int) -> DataFrame:
    """Pass two: ``df`` with ``_qb_maybe``, false where no other row can be equal. ``repeated`` is staged."""
    word, bits = _word_and_bits(F.col(h), words)
    df = df.withColumns({"_qb_word": word, "_qb_bits": bits}).join(small(repeated, BROADCAST_WORDS), "_qb_word", "left")
    maybe = F.coalesce(F.col("_qb_set").bitwiseAND(F.col("_qb_bits")) == F.col("_qb_bits"), F.lit(False))
    return df.withColumn("_qb_maybe", maybe).drop("_qb_word", "_qb_bits", "_qb_set")


def _marks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows surely without a copy (``doc_id, copy, sha``), and the others with ``keep_id, group_size, kept`` besides.

    ``copy`` is a hash of the text as it is.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("copy"), F.unhex(F.sha2(fold_ascii(text), 256)).alias("sha"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "exact-hashes")
    rows = rows.withColumn("_q_h", F.xxhash64("sha"))
    n = rows.count()
    words = filter_words(n)
    rows = possible_repeats(rows, "_q_h", stage(repeated_bits(rows, "_q_h", words), "exact-filter"), words).drop("_q_h")
    alone = rows.where(~F.col("_qb_maybe")).select("doc_id", "copy", "sha")
    maybe = stage(rows.where("_qb_maybe").drop("_qb_maybe"), "exact-maybe")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(groups.select("sha", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "exact-groups")
    if groups.count() <= BROADCAST_ROWS:
        marked = maybe.join(F.broadcast(groups), "sha")
    else:
        # groups of more than 1 in HOT_GROUPS rows are at most HOT_GROUPS: their rows need no shuffle
        hot = F.col("group_size") > n / HOT_GROUPS
        large = F.broadcast(groups.where(hot))
        marked = maybe.join(large, "sha").unionByName(maybe.join(large.select("sha"), "sha", "left_anti").join(groups.where(~hot), "sha"))
    return alone, marked.select("doc_id", "copy", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def duplicate_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    alone, marked = _marks(docs, id_col, text_col)
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    every = alone.unionByName(marked.drop("copy"))
    return every.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    The rows that go are found on hashes alone; the documents then pass from
    scan to output by a broadcast list of those that go, up to
    ``BROADCAST_WORDS`` of them, and by a shuffled join beyond.
    """
    _, marked = _marks(docs, id_col, text_col)
    ids = ["_qd_id", "_qd_copy"]
    rows = marked.select(F.col("doc_id").alias("_qd_id"), F.col("copy").alias("_qd_copy"), "kept").groupBy(*ids).agg(F.count(F.lit(1)).alias("_qd_n"), F.bool_or("kept").alias("_qd_kept"))
    rows = stage(rows.where("not _qd_kept or _qd_n > 1"), "exact-decided")
    same = F.col(id_col).eqNullSafe(F.col("_qd_id")) & (F.xxhash64(text_col) == F.col("_qd_copy"))
    left = docs.join(small(rows.where("not _qd_kept").select(*ids), BROADCAST_WORDS), same, "left_anti")
    twice = rows.where("_qd_kept").select(*ids)  # rows equal in id and text, one of which stays
    if twice.isEmpty():
        return left
    twice = small(twice, BROADCAST_WORDS)
    once = left.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(twice, same, "left_anti").unionByName(once)

