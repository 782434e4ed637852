"""Incremental ingestion: documents that arrive in a folder are chunked and indexed as they come (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.retrieval import postings


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, title string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def index_stream(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, delay: str = "1 hour"):
    """Chunks and their postings appended under ``out``; documents that come twice within ``delay`` count once."""
    fresh = docs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"])

    def write(batch: DataFrame, epoch: int) -> None:
        chunks = chunker(batch.drop("ts")).withColumn("epoch", F.lit(epoch))
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/epoch={epoch}")  # a batch that is run again replaces itself
        stored = batch.sparkSession.read.parquet(f"{out}/chunks/epoch={epoch}")
        keyed = stored.withColumn("chunk_id", F.concat_ws(":", "doc_id", "source"))
        postings(keyed, "chunk_id", F.col("content")).write.mode("overwrite").parquet(f"{out}/postings/epoch={epoch}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_windows(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and values of events by type and tumbling window, for a stream or a table."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
