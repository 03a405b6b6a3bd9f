"""Telemetry and file changes as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, like: DataFrame, late: str = "1 hour", per_batch: int = 8) -> DataFrame:
    """Events of a folder of Parquet files as a stream with event time ``at``."""
    source = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return source.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def rolled_up(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; works alike on a stream and on a table with ``at``."""
    return (
        events.groupBy(F.window("at", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): sessions that end after a gap."""
    return events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduped(events: DataFrame) -> DataFrame:
    """Each event id once inside the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def write_rollup(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows, appended as Parquet; ends when the input is used up."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of file changes to a dirty plan."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
