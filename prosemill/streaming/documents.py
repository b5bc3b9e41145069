"""The operators over streams of documents.

Scoring, extraction and verdicts look at one row at a time, so they run unchanged on a stream.  What needs a whole
document's rows together runs per micro-batch, and counts over time use event-time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts, readability


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def scored_stream(docs: DataFrame) -> DataFrame:
    return readability.readability(docs.select("doc_id", "text")).drop("text")


def fact_stream(docs: DataFrame) -> DataFrame:
    return facts.facts(docs)


def per_batch(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply an operator to each micro-batch and append its rows; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
