"""Departure slots over a stream of stop events: tumbling windows with a watermark, late events dropped beyond it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Events with a watermark; times without a zone are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def unique_events(events: DataFrame, keys: Sequence[str], time: str = "ts", late: str = "30 minutes") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark(list(keys))


def slot_counts(events: DataFrame, key: str, time: str = "ts", value: str = "value", slot: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Per slot and key the number of events, with least and largest value; the same on a stream and on a table."""
    rows = _timed(events, time, late).groupBy(F.window(time, slot).alias("w"), key)
    out = rows.agg(F.count("*").alias("aantal"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return out.select(F.col("w.start").alias("slot"), key, "aantal", "minimum", "maximum")


def trips(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a gap: session windows."""
    out = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("aantal"))
    return out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("einde"), key, "aantal")


def refresh(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A running query that hands every micro-batch to ``apply``, such as one that overwrites a mode's partition."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
