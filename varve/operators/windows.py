"""Window operators: centring, ranks, multiple testing, runs, blocks and leave-one-out.

Every function takes the grouping columns explicitly, so the work is spread over
groups.  A family-wide rank (``by`` empty) is meant for tables of results such
as p-values, not for raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window, WindowSpec


def over(by: Sequence[str], *order) -> WindowSpec:
    w = Window.partitionBy(*by)
    return w.orderBy(*order) if order else w


def zscore(value: str, by: Sequence[str], ddof: int = 0) -> Column:
    """Standard score within groups; zero where the spread is zero or unknown."""
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value).over(over(by))
    return F.coalesce((F.col(value) - F.avg(value).over(over(by))) / F.nullif(sd, F.lit(0.0)), F.lit(0.0))


def centred(value: str, by: Sequence[str]) -> Column:
    return F.col(value) - F.avg(value).over(over(by))


def group_weight(by: Sequence[str]) -> Column:
    return F.lit(1.0) / F.count(F.lit(1)).over(over(by))


def days_since_first(date: str, by: Sequence[str]) -> Column:
    return F.datediff(F.col(date), F.min(date).over(over(by)))


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank with ties sharing the mean of their places."""
    ties = F.count(F.lit(1)).over(over([*by, value]))
    return F.rank().over(over(by, value)) + (ties - 1) / F.lit(2.0)


def range_edges(df: DataFrame, value: str, buckets: int = 256) -> list:
    """Values that cut a column into at most ``buckets`` ranges, in its own order: numbers by approximate quantiles,
    text, dates and whatever else can be ordered by a bounded sample of the values with the least hashes."""
    if isinstance(df.schema[value].dataType, NumericType):
        cuts = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
        return sorted(set(cuts or []))
    known = df.select(F.col(value).alias("v")).filter("v IS NOT NULL")
    sample = [r[0] for r in known.orderBy(F.xxhash64("v")).limit(16 * buckets).distinct().orderBy("v").collect()]
    step = max(1, len(sample) // buckets)
    return sample[step::step][: buckets - 1]


def range_of(value: str, edges: Sequence) -> Column:
    """In which of the ranges a value lies."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(value))) if edges else F.lit(0)


def _same(by: Sequence[str], mark: str) -> Column:
    """Join condition of the columns ``by`` with their twins led by ``mark``, nulls alike; hashed once more so that a hot group can be split."""
    out = F.xxhash64(*[F.col(c) for c in by], F.lit(1)) == F.xxhash64(*[F.col(f"{mark}{c}") for c in by], F.lit(1))
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"{mark}{c}"))
    return out


def global_places(df: DataFrame, value: str, buckets: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """(by, __v, __n, __below): each distinct value, how many rows hold it and how many hold a lesser one, of all rows or of each group.

    No task sees all rows of a group: distinct values are counted first and cut into
    ranges; below a value lies what is in the ranges below and what is below it in its own.
    """
    by = list(by)
    b = range_of(value, range_edges(df, value, buckets))
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", b)
    below = n.groupBy(*by, "__b").agg(F.sum("__n").alias("__t"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows a group
    below = below.select(*[F.col(c).alias(f"__p_{c}") for c in by], F.col("__b").alias("__p___b"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = over([*by, "__b"], value).rowsBetween(Window.unboundedPreceding, -1)
    lesser = F.col("__o") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    met = n.join(below, _same([*by, "__b"], "__p_")) if by else n.join(F.broadcast(below), F.col("__b") == F.col("__p___b"))
    return met.select(*by, F.col(value).alias("__v"), "__n", lesser.alias("__below"))


def prefix_sums(df: DataFrame, order: str, cols: Sequence[str], out: str = "__i", buckets: int = 256) -> DataFrame:
    """``order``, its place from 0 (``out``) and, under each name of ``cols``, the sum of the rows before it; ``order`` is unique.

    Rows are cut into ranges of ``order``; only a range is ordered in one task.
    """
    rows = df.select(order, *cols).withColumn("__b", range_of(order, range_edges(df, order, buckets)))
    parts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__t"), *[F.sum(c).alias(f"__t_{c}") for c in cols])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    parts = parts.select("__b", *[F.coalesce(F.sum(f"__t{c}").over(before), none).alias(f"__o{c}") for c in ("", *[f"_{c}" for c in cols])])
    inside = over(["__b"], order).rowsBetween(Window.unboundedPreceding, -1)
    place = (F.count(F.lit(1)).over(inside) + F.col("__o")).cast("long")
    sums = [(F.coalesce(F.sum(c).over(inside), none) + F.col(f"__o_{c}")).alias(c) for c in cols]
    return rows.join(F.broadcast(parts), "__b").select(order, place.alias(out), *sums)


def global_average_rank(df: DataFrame, value: str, out: str = "rank", buckets: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the average rank of ``value`` among all rows or those of its group; null values have none."""
    by = list(by)
    ranks = global_places(df, value, buckets, by).select(*[F.col(c).alias(f"__p_{c}") for c in by], F.col("__v").alias(f"__p_{value}"), (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, _same([*by, value], "__p_") & F.col(value).isNotNull(), "left").drop(*[f"__p_{c}" for c in [*by, value]])


def grouped_quantiles(df: DataFrame, value: str, fractions: dict[str, float], by: Sequence[str]) -> DataFrame:
    """Exact linear quantiles of each group under the names of ``fractions``, from counts of distinct values; a group is no single task."""
    by = list(by)
    places = global_places(df, value, 256, by)
    total = places.groupBy(*by).agg(F.sum("__n").alias("__t")).select(*[F.col(c).alias(f"__q_{c}") for c in by], "__t")
    met = places.join(total, _same(by, "__q_"))
    found = []
    for name, f in fractions.items():
        at = F.lit(f) * (F.col("__t") - 1)
        low, high = F.floor(at), F.least(F.floor(at) + 1, F.col("__t") - 1)
        holds = lambda k: (F.col("__below") <= k) & (k < F.col("__below") + F.col("__n"))
        pick = lambda k: F.max(F.when(holds(k), F.col("__v")))
        found += [pick(low).alias(f"__l_{name}"), pick(high).alias(f"__h_{name}"), F.max(at - low).alias(f"__w_{name}")]
    out = met.groupBy(*by).agg(*found)
    return out.select(*by, *[(F.col(f"__l_{k}") + F.col(f"__w_{k}") * (F.col(f"__h_{k}") - F.col(f"__l_{k}"))).alias(k) for k in fractions])


def global_quantiles(df: DataFrame, value: str, fractions: Sequence[float]) -> list[float]:
    """Exact linear quantiles of all rows; nothing where no value is known.

    Only the values at the wanted places reach the driver, two for each fraction.
    """
    total = df.agg(F.count(value)).first()[0]
    if not total:
        return []
    at = [f * (total - 1) for f in fractions]
    wanted = sorted({p for x in at for p in (int(x), min(int(x) + 1, total - 1))})
    places = global_places(df, value).withColumn("__p", F.explode(F.array(*[F.lit(p) for p in wanted])))
    held = places.filter((F.col("__below") <= F.col("__p")) & (F.col("__p") < F.col("__below") + F.col("__n")))
    found = {r["__p"]: float(r["__v"]) for r in held.select("__p", "__v").collect()}
    return [found[int(x)] + (x - int(x)) * (found[min(int(x) + 1, total - 1)] - found[int(x)]) for x in at]


def indexed(df: DataFrame, unit: str, out: str = "__i") -> DataFrame:
    """``df`` with the place from 0 of each row in order of ``unit``, which is unique; no task sees all rows."""
    return global_average_rank(df, unit, out).withColumn(out, (F.col(out) - 1).cast("long"))


def ranked(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """``df`` with average ranks within groups, or among all rows where there are no groups."""
    return global_average_rank(df, value, out, by=by)


def leave_one_out(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the mean of all other rows' values."""
    whole = df.agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    mean = (F.col("__s") - F.col(value)) / F.nullif(F.col("__n") - 1, F.lit(0))
    return df.crossJoin(F.broadcast(whole)).withColumn(out, mean).drop("__s", "__n")


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q", buckets: int = 256) -> DataFrame:
    """Step-up q values within a family; a null p has no q and does not count.

    A family is cut into ranges of p.  A value's step is p n / (how many are no
    greater); its q is the least step from it upwards: that of its own range and the
    least of each range above, so no task orders a whole family.
    """
    by = list(by)
    edges = range_edges(df, p, buckets)
    steps = global_places(df, p, buckets, by)
    n = steps.groupBy(*by).agg(F.sum("__n").alias("__t")).select(*[F.col(c).alias(f"__f_{c}") for c in by], "__t")
    steps = steps.join(n, _same(by, "__f_")) if by else steps.crossJoin(F.broadcast(n))
    steps = steps.withColumn("__s", F.col("__v") * F.col("__t") / (F.col("__below") + F.col("__n"))).withColumn("__b", range_of("__v", edges))
    above = Window.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows a family
    least = steps.groupBy(*by, "__b").agg(F.min("__s").alias("__m"))
    least = least.select(*[F.col(c).alias(f"__u_{c}") for c in by], F.col("__b").alias("__u___b"), F.min("__m").over(above).alias("__a"))
    tail = over([*by, "__b"], F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("__s").over(tail), F.col("__a"))
    found = steps.join(least, _same([*by, "__b"], "__u_")).select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__v").alias(f"__k_{p}"), q.alias(out))
    return df.join(found, _same([*by, p], "__k_") & F.col(p).isNotNull(), "left").drop(*[f"__k_{c}" for c in [*by, p]])


def bonferroni(p: str, by: Sequence[str] = ()) -> Column:
    return F.least(F.lit(1.0), F.col(p) * F.count(p).over(over(by)))


def running_sum(value: str, by: Sequence[str], *order) -> Column:
    return F.sum(value).over(over(by, *order).rowsBetween(Window.unboundedPreceding, 0))


def runs(df: DataFrame, active: str, by: Sequence[str], order: str) -> DataFrame:
    """Runs of consecutive active rows: their first and last ``order`` and their length."""
    w = over(by, order)
    df = df.withColumn("__c", F.coalesce((F.col(active) != F.lag(active).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        df.filter(F.col(active))
        .groupBy(*by, "run")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))
    )


def first_per_key(df: DataFrame, by: Sequence[str], *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(over(by, *order))).filter("__n = 1").drop("__n")


def top_per_group(df: DataFrame, k: int, by: Sequence[str], *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(over(by, *order))).filter(F.col("place") <= k)


def floor_blocks(n_blocks: int, by: Sequence[str], *order) -> Column:
    """Contiguous block of a row: floor(i * B / n) for the 0-based place i."""
    i = F.row_number().over(over(by, *order)) - 1
    return F.floor(i * n_blocks / F.count(F.lit(1)).over(over(by)))


def even_blocks(n_blocks: int, by: Sequence[str], *order) -> Column:
    """Contiguous blocks whose first n mod B have one row more."""
    return F.ntile(n_blocks).over(over(by, *order)) - 1


def digitise(value: Column, edges: Column) -> Column:
    """How many of the edges are at or below a value."""
    return F.aggregate(edges, F.lit(0), lambda a, e: a + (value >= e).cast("int"))


def quantile_edges(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Distinct linear quantiles at 1/bins, 2/bins, ... of each group, or of all rows where there are no groups."""
    if not by:
        edges = list(dict.fromkeys(global_quantiles(df, value, [i / bins for i in range(1, bins)])))
        return df.sparkSession.range(1).select(F.array(*[F.lit(e) for e in edges]).cast("array<double>").alias("edges"))
    q = F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    return df.groupBy(*by).agg(F.array_distinct(q).alias("edges"))


def near_flag(flag: str, width: int, by: Sequence[str], order: str) -> Column:
    """Whether any of the ``width`` rows before or after is flagged."""
    w = over(by, order)
    side = lambda a, b: F.coalesce(F.max(flag).over(w.rowsBetween(a, b)), F.lit(False))
    return side(-width, -1) | side(1, width)


def distance_to_ends(by: Sequence[str], order: str) -> Column:
    i = F.row_number().over(over(by, order))
    return F.least(i - 1, F.count(F.lit(1)).over(over(by)) - i)


def leave_one_out_mean(value: str, by: Sequence[str]) -> Column:
    w = over(by)
    return (F.sum(value).over(w) - F.col(value)) / F.nullif(F.count(value).over(w) - 1, F.lit(0))
