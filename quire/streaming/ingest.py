"""Files as a stream: new documents are parsed as they arrive.

Every document is independent, so no state or watermark is needed; pages and
documents of a micro-batch are complete within it. With a checkpoint folder
each file is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import pdf


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000, glob: str = "*") -> DataFrame:
    """``doc_id, length, content`` of files as they appear."""
    schema = spark.read.format("binaryFile").load(path).schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).load(path)
    return stream.select(F.col("path").alias("doc_id"), "length", "content")


def run_stream(stream: DataFrame, password: str = "") -> DataFrame:
    """Text runs of arriving files, in append mode."""
    return pdf.text_runs(pdf.pages(pdf.only_pdfs(stream), password))


def ingest(stream: DataFrame, sink: str, checkpoint: str, password: str = "", once: bool = True) -> StreamingQuery:
    """Write a row per arriving document to ``sink`` (Parquet)."""

    def write(batch: DataFrame, epoch: int) -> None:
        pdf.extract_documents(batch, password).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(sink)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
