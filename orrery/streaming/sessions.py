"""Stretches of events without long gaps, in batches and in streams that keep their state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap_s: float, late_s: float | None = None) -> DataFrame:
    """(keys, first, last, n): runs of a key's events of which none is more than gap_s after the one before.

    In a stream (late_s: how much later than the newest events may come) a run is
    returned when the watermark has passed its end, and events behind that are
    dropped. In a batch late_s has no effect. Events without a time are left out.
    """
    rows = events.filter(F.col(time).isNotNull())
    if events.isStreaming:
        rows = rows.withWatermark(time, f"{late_s or 0} seconds")
    gap = f"{round(gap_s * 1e6) + 1} microseconds"  # windows end before their end
    return rows.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("_w")


def run(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, keys: Sequence[str], time: str, gap_s: float, late_s: float, each: int = 1) -> StreamingQuery:
    """A stream of Parquet files, `each` at a time by their age, whose closed runs are appended to a folder; ends when all files are taken. Run again it goes on where it was, with the runs that were open."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(folder)
    found = sessions(rows, keys, time, gap_s, late_s)
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
