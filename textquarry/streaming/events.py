"""Structured Streaming: windows, dedup and sessions over an event stream. Window types are extensions of the engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets its watermark, which needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    w = _timed(events, late)
    return w.groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, late)
    return w.groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """A session ends when the gap is over; an equal gap still belongs to it."""
    w = _timed(events, late)
    return w.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def upsert_batches(stream: DataFrame, merge) -> object:
    """Runs ``merge(batch, epoch)`` once for each micro-batch; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.foreachBatch(merge)
