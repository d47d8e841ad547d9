"""The event log as a stream: resume, delivery without repeats, windows by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_events(raw: DataFrame, ts: str = "ts") -> DataFrame:
    """A stream's rows with a zoned event time: watermarks are not defined on zone-less timestamps."""
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def resume(stream: DataFrame, last_seen: int) -> DataFrame:
    return stream.where(F.col("event_id") > last_seen)


def delivered_once(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it arrives within the delay that is waited for."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def per_day(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    days = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"))
    return days.agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table in memory; for tests and small feeds."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
