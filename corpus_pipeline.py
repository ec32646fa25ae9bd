"""From raw documents to token ids: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)``, works on everything that the one
before it kept, and returns a DataFrame that is written as Parquet and reread
as the next one's ``docs``. All but the last return the columns of documents.
Null and empty texts pass every filter (they aren't toxic; of empty texts one
stays) and encode to no ids. Each begins by giving back the heap that others left
to the executors, and does so again between two steps that need much of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import encode_decode
from quire.llm.common import give_back_heaps, kept, scratch, table
from quire.llm.exact_dedup import exact_dedup
from quire.llm.mixing import mix, places
from quire.llm.near_dedup import near_dedup
from quire.llm.toxicity import THRESHOLD, fit, score_documents

#: Target weights of sources: their bytes to this power.
TEMPERATURE = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    give_back_heaps(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    give_back_heaps(spark)
    return score_documents(docs, model, out="_qt_score").where(F.col("_qt_score") < THRESHOLD).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    give_back_heaps(spark)
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the document with the smallest id."""
    give_back_heaps(spark)
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, interleaved so that sources keep to their target weights."""
    give_back_heaps(spark)
    return mix(docs, temperature=TEMPERATURE)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, packed as little-endian unsigned 32-bit integers, and its place in the mixture.

    Files that are reread come in any order, so the schedule, which depends on
    the documents alone, is worked out again: ``slot, start`` is the order.
    """
    import public_tokenizers

    give_back_heaps(spark)
    order = ["_qm_slot", "_qm_start"]
    placed = places(docs, temperature=TEMPERATURE)
    give_back_heaps(spark)
    out = encode_decode(placed, public_tokenizers.path("byte_bpe_50k.json"), keep=order)
    return out.select("doc_id", F.col("_qm_slot").alias("slot"), F.col("_qm_start").alias("start"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: The learned, hashed and encoded stages are beyond SQL; tests/llm compares the pipeline with a brute-force one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with scratch(spark):  # what a stage's operator wrote on its way goes once its result is there
            docs = kept(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
