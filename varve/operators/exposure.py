"""Time-lag exposures: sums of a daily series over windows before or after a visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulated(daily: DataFrame, site: str, date: str, value: str) -> DataFrame:
    """(__s, __d, __c, __low, __high): for each calendar day of a site, from the day before its first on, the sum of ``value`` up to that day."""
    d = daily.groupBy(F.col(site).alias("__s"), F.col(date).cast("date").alias("__d")).agg(F.sum(value).alias("__v"))
    ends = d.groupBy("__s").agg(F.date_sub(F.min("__d"), 1).alias("__low"), F.max("__d").alias("__high"))
    days = ends.withColumn("__d", F.explode(F.sequence("__low", "__high")))
    upto = Window.partitionBy("__s").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(d, ["__s", "__d"], "left").withColumn("__c", F.sum(F.coalesce("__v", F.lit(0.0))).over(upto)).drop("__v")


def interval_sums(visits: DataFrame, daily: DataFrame, keys: Sequence[str], site: str, date: str, value: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """For each visit the sum of ``value`` over days date - last .. date - first of its site.

    ``windows`` maps an output column to (first, last) lags; negative lags lie in
    the future.  Each window is the difference of two days of the site's cumulated
    series, found by exact date: two lookups a window, however long it is and
    however many days the site has.  Days without a value count as zero.
    """
    c = cumulated(daily, site, date, value)
    ends = c.select("__s", "__low", "__high").distinct()
    names = list(windows)
    ask = [F.struct(F.lit(k).alias("k"), F.lit(sign).alias("g"), F.date_sub(date, lag).alias("d")) for k, w in enumerate(windows.values()) for sign, lag in ((1, w[0]), (-1, w[1] + 1))]
    asked = visits.select(*keys, F.col(site).alias("__site"), F.explode(F.array(*ask)).alias("__w"))
    asked = asked.join(ends.withColumnRenamed("__s", "__e"), F.col("__site") == F.col("__e"), "left")
    at = F.greatest(F.col("__low"), F.least(F.col("__high"), F.col("__w.d")))
    asked = asked.select(*keys, "__site", F.col("__w.k").alias("__k"), F.col("__w.g").alias("__g"), at.alias("__at"))
    met = asked.join(c.select("__s", "__d", "__c"), (F.col("__site") == F.col("__s")) & (F.col("__at") == F.col("__d")), "left")
    sums = [F.coalesce(F.sum(F.when(F.col("__k") == k, F.col("__g") * F.col("__c"))), F.lit(0.0)).alias(name) for k, name in enumerate(names)]
    return met.groupBy(*keys).agg(*sums)


def lag_table(visits: DataFrame, daily: DataFrame, visit: str, site: str, date: str, value: str, horizon: int, future: bool = False) -> DataFrame:
    """One row for each visit and lag 1..horizon with the value of that day, zero where there is none."""
    step = 1 if future else -1
    grid = visits.select(visit, site, date, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lag"))
    grid = grid.withColumn("__d", F.date_add(F.col(date), (F.col("lag") * step).cast("int")))
    d = daily.select(F.col(site).alias("__s"), F.col(date).alias("__e"), F.col(value).alias(value))
    df = grid.join(d, (F.col(site) == F.col("__s")) & (F.col("__d") == F.col("__e")), "left")
    return df.select(visit, site, date, "lag", F.coalesce(value, F.lit(0.0)).alias(value))


def pulse(lag: Column, peak: Column) -> Column:
    """Gamma pulse that is one at its peak: (l / p) exp(1 - l / p)."""
    return lag / peak * F.exp(1 - lag / peak)


def calendar_gaps(daily: DataFrame, site: str, date: str) -> DataFrame:
    """Days missing between the first and the last of each site."""
    ends = daily.groupBy(site).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = ends.select(site, F.explode(F.sequence("a", "b")).alias(date))
    return days.join(daily.select(site, date), [site, date], "left_anti")
