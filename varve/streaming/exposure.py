"""Continuous forms of the exposure operators on an unbounded event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, key: str, time: str, value: str, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Sum and count for each key and tumbling or sliding window; later rows than ``late`` are dropped."""
    w = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    out = events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")


def sessions(events: DataFrame, key: str, time: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of events no further apart than ``gap``: the continuous form of gaps and islands."""
    out = events.withWatermark(time, late).groupBy(key, F.session_window(F.col(time), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_join(visits: DataFrame, readings: DataFrame, key: str, visit_time: str, reading_time: str, back: str = "3 days", late: str = "4 days") -> DataFrame:
    """Readings of the same key in the interval before each visit, as a stream-stream join with bounded state."""
    v = visits.withWatermark(visit_time, late)
    r = readings.withColumnRenamed(key, f"__{key}").withWatermark(reading_time, late)
    on = (F.col(key) == F.col(f"__{key}")) & (F.col(reading_time) <= F.col(visit_time)) & (F.col(reading_time) > F.col(visit_time) - F.expr(f"interval {back}"))
    return v.join(r, on).drop(f"__{key}")
