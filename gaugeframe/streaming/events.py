"""Structured Streaming over event tables: an addition of this library, as evaluation data has no streams of its own.

Late rows are dropped by the watermark, and repeated event ids within it count
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours", key: str | None = "event_id") -> DataFrame:
    """``start, kind, n, total`` per tumbling window; works on streams and on tables."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(ts, late)
        if key:
            e = e.dropDuplicatesWithinWatermark([key])
    elif key:
        e = e.dropDuplicates([key])
    return e.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user, start, stop, n`` per session of a user, closed by a gap."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def append_once(stream: DataFrame, target: str, checkpoint: str, key: str):
    """Append a scored stream to a Parquet table; a batch that is run again adds only ids that are not there."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
