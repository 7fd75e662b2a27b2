"""Streaming ingest of deliveries: late and repeated rows, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a time with a zone; times without one are taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def once(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """The first delivery of each key; state is kept for the time span ``late`` after the latest row."""
    return _timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "sample_id", time: str = "ingested_at", late: str = "30 days", available_now: bool = True) -> StreamingQuery:
    """Append new deliveries to a Parquet table partitioned by dataset; restarts neither lose nor repeat rows."""
    writer = once(stream, key, time, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("dataset_idx").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
