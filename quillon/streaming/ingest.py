"""Streaming ingest: files or rows that arrive are put into a collection batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Collection


def ingest_stream(rows: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Takes in what there is of a stream of (source, text). A batch that is run again changes nothing, since equal
    documents are passed over. Texts without tokens are passed over too: one file must not stop the stream."""
    return rows.writeStream.foreachBatch(lambda batch, _: batch.isEmpty() or collection.upsert(batch, empty="skip")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Text files as (source, text), as they appear in a folder."""
    return spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) by window and type, with a watermark for late ones; batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
