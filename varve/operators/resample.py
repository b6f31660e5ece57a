"""Resampling by hash draws: every draw is a function of (seed, draw, unit), so results repeat on any cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators.windows import indexed, over


def hash_draw(seed: int, *cols) -> Column:
    """A 32-bit number from the MD5 of the seed and the columns, joined by bars."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draws(df: DataFrame, n: int) -> DataFrame:
    """``df`` once for each draw 0..n-1."""
    return df.crossJoin(F.broadcast(df.sparkSession.range(n).select(F.col("id").alias("draw"))))


def bootstrap_means(units: DataFrame, unit: str, value: str, n: int, seed: int) -> DataFrame:
    """Mean of each resample of the units: slot k of draw d takes unit ``hash % count``.

    Work and shuffle are units x draws; ``poisson_means`` resamples raw rows without a shuffle.
    """
    ranked = indexed(units.select(unit, value), unit).select("__i", value)
    size = units.agg(F.count(F.lit(1)).alias("__n"))
    slots = draws(ranked.select(F.col("__i").alias("slot")), n).crossJoin(F.broadcast(size))
    picks = slots.select("draw", (hash_draw(seed, "draw", "slot") % F.col("__n")).alias("__i"))
    return picks.join(ranked, "__i").groupBy("draw").agg(F.avg(value).alias("mean"))


#: chance of at most k for a Poisson count of mean one
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def poisson_means(rows: DataFrame, unit: str, value: str, n: int, seed: int) -> DataFrame:
    """Mean of each Poisson resample: a row counts as often as a Poisson draw of mean one from its hash says.

    Every draw is a partial sum next to the scan, whatever the number of rows.
    """
    u = hash_draw(seed, "draw", unit) / F.lit(float(1 << 32))
    times = reduce(lambda a, b: a + b, [(u >= c).cast("int") for c in POISSON])
    many = draws(rows.select(unit, value), n).withColumn("__m", times)
    return many.groupBy("draw").agg((F.sum(F.col("__m") * F.col(value)) / F.sum("__m")).alias("mean"))


def block_bootstrap(blocks: DataFrame, block: str, sums: Sequence[str], n: int, seed: int) -> DataFrame:
    """Sums of whole-block resamples from one row of sufficient statistics for each block."""
    ranked = indexed(blocks.select(block, *sums), block)
    size = blocks.agg(F.count(F.lit(1)).alias("__n"))
    slots = draws(ranked.select(F.col("__i").alias("slot")), n).crossJoin(F.broadcast(size))
    times = slots.select("draw", (hash_draw(seed, "draw", "slot") % F.col("__n")).alias("__i")).groupBy("draw", "__i").agg(F.count(F.lit(1)).alias("__m"))
    return times.join(ranked, "__i").groupBy("draw").agg(*[F.sum(F.col("__m") * F.col(c)).alias(c) for c in sums])


def multiplicities(units: DataFrame, unit: str, n: int, seed: int) -> DataFrame:
    """(draw, unit, times): how often each resample of the distinct units takes each of them, those it leaves out not listed."""
    ranked = indexed(units.select(unit).distinct(), unit)
    size = ranked.agg(F.count(F.lit(1)).alias("__n"))
    slots = draws(ranked.select(F.col("__i").alias("slot")), n).crossJoin(F.broadcast(size))
    picks = slots.select("draw", (hash_draw(seed, "draw", "slot") % F.col("__n")).alias("__i"))
    return picks.groupBy("draw", "__i").agg(F.count(F.lit(1)).alias("times")).join(ranked, "__i").select("draw", unit, "times")


def sign_flips(units: DataFrame, unit: str, value: str, n: int, seed: int) -> DataFrame:
    """Mean of each draw with every unit's sign kept or flipped."""
    sign = F.when(hash_draw(seed, "draw", unit) % 2 == 0, 1).otherwise(-1)
    return draws(units.select(unit, value), n).groupBy("draw").agg(F.avg(sign * F.col(value)).alias("mean"))


def permuted(df: DataFrame, unit: str, label: str, n: int, seed: int, within: Sequence[str] = ()) -> DataFrame:
    """For each draw the units of a stratum with its labels in hash order."""
    many = draws(df.select(*within, unit, label), n)
    natural = F.row_number().over(over([*within, "draw"], unit))
    shuffled = F.row_number().over(over([*within, "draw"], hash_draw(seed, "draw", unit), unit))
    a = many.select(*within, "draw", unit, natural.alias("__n"))
    b = many.select(*within, "draw", label, shuffled.alias("__n"))
    return a.join(b, [*within, "draw", "__n"]).drop("__n")


def circular_shift(df: DataFrame, by: Sequence[str], order: str, value: str, n: int, seed: int) -> DataFrame:
    """For each draw the series of a group rolled by a hash-drawn number of places."""
    size = F.count(F.lit(1)).over(over(by))
    at = df.select(*by, order, value, (F.row_number().over(over(by, order)) - 1).alias("__p"), size.alias("__n"))
    many = draws(at, n)
    moved = F.pmod(F.col("__p") + hash_draw(seed, "draw", *by), F.col("__n"))
    target = many.select(*by, "draw", order, F.col("__p"))
    source = many.select(*by, "draw", value, moved.cast("long").alias("__p"))
    return target.join(source, [*by, "draw", "__p"]).drop("__p")


def plus_one_p(null: DataFrame, value: str, observed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(1 + draws at least as large) / (1 + draws) over finite draws; ``observed`` has column ``observed``."""
    df = null.join(observed, list(by)) if by else null.crossJoin(F.broadcast(observed))
    return df.groupBy(*by, "observed").agg(
        ((1 + F.sum((F.col(value) >= F.col("observed") - 1e-12).cast("int"))) / (1 + F.count(value))).alias("p")
    )
