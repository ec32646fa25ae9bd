"""The operators' registered queries: thin bindings to the tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), temperature=0.5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import shared_path
    from quire.llm.warc import page_key, read_warc, write_warc

    files = write_warc(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    records = read_warc(spark, files, payloads=False).where("record_type in ('response', 'revisit')")
    return records.select(
        page_key("record_id").try_cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page_key("refers_to_id").try_cast("long").alias("refers_to"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.exact_dedup import duplicate_marks

    return duplicate_marks(table(spark, sf_dir, "documents"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.common import shared_path
    from quire.llm.token_files import read_token_files, write_token_files

    folder = shared_path(spark, "token-files")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import THRESHOLD, fit, fold, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold() == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.near_dedup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_toxicity, op3_mixing, op4_warc, op5_exact_dedup, op6_importance, op7_bpe, op8_nearest, op9_sharding, op10_near_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT *, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, strlen(body) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
}
