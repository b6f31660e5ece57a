"""User statistics over groups and resamples.

Column aggregates stay partial sums on the cluster.  A statistic that is no Column is
a function of an Arrow array of a group's values (``array_statistic``); the group then
passes one task, so it is meant for groups of units, not for raw rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators.resample import draws, hash_draw


def statistic(df: DataFrame, aggregates: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Named aggregates of a table or of its groups."""
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()])


def bootstrap(df: DataFrame, unit: str, aggregates: dict[str, Column], n: int, seed: int) -> DataFrame:
    """Named aggregates of each resample of the units, drawn with hash-derived multiplicities."""
    from varve.operators.windows import indexed

    units = indexed(df.select(unit).distinct(), unit)
    size = units.agg(F.count(F.lit(1)).alias("__n"))
    slots = draws(units.select(F.col("__i").alias("slot")), n).crossJoin(F.broadcast(size))
    picks = slots.select("draw", (hash_draw(seed, "draw", "slot") % F.col("__n")).alias("__i")).join(units, "__i").select("draw", unit)
    return statistic(picks.join(df, unit), aggregates, ["draw"])


def array_statistic(statistic: Callable[[pa.Array], float | None]) -> Callable[[str], Column]:
    """A function from an Arrow array of known values to a number, as an aggregate of a column; null for a group without any."""

    @F.arrow_udf("double")
    def aggregate(values: pa.Array) -> float:
        known = values.drop_null()
        return statistic(known) if len(known) else None

    return lambda value: aggregate(F.col(value).cast("double"))


def trimmed_mean(values: pa.Array, share: float = 0.1) -> float:
    """The mean without the least and the greatest ``share`` of the values."""
    cut = int(len(values) * share)
    return pc.mean(pc.take(values, pc.sort_indices(values)).slice(cut, len(values) - 2 * cut)).as_py()
