"""Structured Streaming: files to chunks, event logs to windowed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.sections import windows


def chunk_stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """New document files in a folder become chunks in a parquet table; every file is read once."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return windows(docs).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def windowed_log(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; what comes later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest")).select("window.start", "window.end", "event_type", "n", "total", "largest")
