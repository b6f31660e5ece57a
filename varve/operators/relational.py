"""Joins, pooling, set overlap and reshaping in long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool(df: DataFrame, keys: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """Replicates pooled to one row for each key: their sum or mean, and how many there were."""
    agg = {"sum": F.sum, "mean": F.avg}[how]
    return df.groupBy(*keys).agg(agg(value).alias(value), F.count(F.lit(1)).alias("n"))


def with_support(df: DataFrame, keys: Sequence[str], value: str, least: float) -> DataFrame:
    """The rows of groups whose total reaches ``least``."""
    total = df.groupBy(*keys).agg(F.sum(value).alias("__t")).filter(F.col("__t") >= least)
    return df.join(total.select(*keys), list(keys), "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


class CardinalityError(ValueError):
    """A join side is not as unique, or not as complete, as was declared."""


def validated_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one", all_left: bool = False
) -> DataFrame:
    """A join whose sides are checked first: ``one_to_one``, ``one_to_many`` or ``many_to_one``."""
    if validate in ("one_to_one", "one_to_many") and not duplicate_keys(left, on).isEmpty():
        raise CardinalityError(f"left keys {list(on)} are not unique")
    if validate in ("one_to_one", "many_to_one") and not duplicate_keys(right, on).isEmpty():
        raise CardinalityError(f"right keys {list(on)} are not unique")
    if all_left and not left.join(right, list(on), "left_anti").isEmpty():
        raise CardinalityError(f"left keys {list(on)} without a match")
    return left.join(right, list(on), how)


def version_diff(old: DataFrame, new: DataFrame, key: str, value: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """Status of every key of two versions: added, absent, revised in value or otherwise, or unchanged."""
    cols = [*value, *other]
    o = old.select(F.col(key).alias("__ok"), *[F.col(c).alias(f"__o_{c}") for c in cols])
    n = new.select(key, *cols)
    same = lambda cs: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in cs], F.lit(True))
    status = (
        F.when(F.col("__ok").isNull(), "ADDED")
        .when(F.col(key).isNull(), "ABSENT")
        .when(~same(value), "REVISED_VALUE")
        .when(~same(other), "REVISED_METADATA")
        .otherwise("UNCHANGED")
    )
    return n.join(o, F.col(key) == F.col("__ok"), "full").select(F.coalesce(key, "__ok").alias(key), status.alias("status"))


def fallback_join(left: DataFrame, right: DataFrame, key: str, alternative: Column, value: str) -> DataFrame:
    """``value`` by the exact key, else by ``alternative``; ``resolution`` names which it was."""
    exact = right.select(F.col(key).alias("__e"), F.col(value).alias("__ev"))
    loose = right.select(F.col(key).alias("__f"), F.col(value).alias("__fv"))
    df = left.join(exact, F.col(key) == F.col("__e"), "left").join(loose, alternative == F.col("__f"), "left")
    how = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__f").isNotNull(), "suffix_fallback").otherwise("unmatched")
    return df.withColumns({value: F.when(F.col("__e").isNotNull(), F.col("__ev")).otherwise(F.col("__fv")), "resolution": how}).drop("__e", "__ev", "__f", "__fv")


def complete_blocks(df: DataFrame, block: Sequence[str], within: str, levels: int) -> DataFrame:
    """The rows of blocks in which all ``levels`` values of ``within`` occur."""
    full = df.groupBy(*block).agg(F.countDistinct(within).alias("__n")).filter(F.col("__n") == levels)
    return df.join(full.select(*block), list(block), "left_semi")


def matrix_product(a: DataFrame, b: DataFrame, on: str, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Sum over ``on`` of left times right for every pair of outer keys."""
    return a.join(b, on).groupBy(*keys).agg(F.sum(F.col(left) * F.col(right)).alias("value"))


def pairs(df: DataFrame, key: str, within: Sequence[str] = (), cols: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of rows (key i < key j), optionally within equal columns."""
    names = [key, *cols]
    a = df.select(*within, *[F.col(c).alias(f"{c}_i") for c in names])
    b = df.select(*[F.col(c).alias(f"__{c}") for c in within], *[F.col(c).alias(f"{c}_j") for c in names])
    on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__{c}") for c in within], F.col(f"{key}_i") < F.col(f"{key}_j"))
    return a.join(b, on).drop(*[f"__{c}" for c in within])


def nearest(df: DataFrame, key: str, x: str, y: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest other points of each point; ties go to the lesser key.

    Points fall into square cells of about k points.  A point meets those of the
    cells around its own; where the k-th of them may be further than a point
    outside, it looks again in a wider square, until all are certain.
    """
    from varve.operators.windows import over, top_per_group
    from varve.session import durable

    b = df.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(key).alias("j"), F.col(x).alias("xj"), F.col(y).alias("yj"))
    lo_x, hi_x, lo_y, hi_y, n = df.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.lit(1))).first()
    wide = float(max(hi_x - lo_x, hi_y - lo_y)) if n and lo_x is not None and lo_y is not None else 0.0
    side = max(((hi_x - lo_x) * (hi_y - lo_y) * (k + 1) / n) ** 0.5, wide * (k + 1) / n, wide * 1e-6) if wide else 1.0
    cell = lambda c, low: F.floor((F.col(c) - F.lit(low or 0.0)) / side)
    b = b.withColumns({"__cx": cell("xj", lo_x), "__cy": cell("yj", lo_y)})
    left = df.select(*by, F.col(key).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    found, reach = None, 1
    while True:
        ring = F.sequence(F.lit(-reach), F.lit(reach))
        a = left.withColumn("__p", F.explode(ring)).withColumn("__q", F.explode(ring))
        a = a.withColumns({"__p": F.col("__p") + cell("xi", lo_x), "__q": F.col("__q") + cell("yi", lo_y)})
        on = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"__{c}") for c in by], (F.col("__p") == F.col("__cx")) & (F.col("__q") == F.col("__cy")))
        d = F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2))
        near = a.join(b, on & (F.col("i") != F.col("j"))).withColumn("distance", d)
        near = top_per_group(near, k, [*by, "i"], F.round("distance", 9), "j")
        if reach * side > wide:
            near = near.select(*by, "i", "j", "distance")
            return near if found is None else found.unionByName(near)
        whole = over([*by, "i"])
        sure = (F.count(F.lit(1)).over(whole) == k) & (F.max("distance").over(whole) < reach * side - 1e-9)
        # each round is written, so the next does not compute it anew
        near = durable(near.withColumn("__sure", sure).filter("__sure").select(*by, "i", "j", "distance"))
        found = near if found is None else found.unionByName(near)
        done = near.select(*by, "i").distinct()
        left = durable(left.join(done, [*by, "i"], "left_anti"))
        if left.isEmpty():
            return found
        reach *= 4


def similar_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float, by: Sequence[str] = (), pivots: int = 32) -> DataFrame:
    """(i, j, similarity): all pairs of a left and a right row, equal in ``by``, whose cosine is at least ``threshold``; vectors without length match nothing.

    Unit vectors of cosine c lie at distance sqrt(2 - 2c), so the join is one of a
    radius.  The right rows are dealt to the nearest of a few of them (``pivots``, those
    with the least hashes).  A left row visits a pivot's cell only where that cell can
    hold a row within the radius: its distance to the pivot exceeds neither the cell's
    reach plus the radius nor its distance to its own nearest pivot by two radii.  No pair
    is lost.  Blocks of a cell's rows are compared by matrix products.  From a radius of
    one on the second rule leaves no cell out, so there all rows are one cell.
    """
    from varve.operators.vectors import alike

    if 2 - 2 * threshold >= 1:
        return alike(left, right, key, vector, threshold, by)
    a, b, _ = _cells(left, right, key, vector, threshold, by, pivots)
    a = a.select(*[F.col(f"__l_{c}").alias(c) for c in by], F.col("__c").alias("__cell"), F.col("i").alias("__key"), F.col("__x").alias("__v"))
    b = b.select(*by, "__cell", F.col("j").alias("__key"), F.col("__y").alias("__v"))
    return alike(a, b, "__key", "__v", threshold, [*by, "__cell"]).drop("__cell")


def similar_candidates(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float, by: Sequence[str] = (), pivots: int = 32) -> DataFrame:
    """The pairs of a cell whose distances to its pivot differ by the radius at most, with both unit vectors: no other can be a pair."""
    a, b, radius = _cells(left, right, key, vector, threshold, by, pivots)
    on = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"__l_{c}") for c in by], F.col("__c") == F.col("__cell"))
    return a.join(b, on & (F.abs(F.col("__from") - F.col("__to")) <= radius)).select(*by, "i", "j", "__x", "__y")


def _cells(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float, by: Sequence[str], pivots: int) -> tuple[DataFrame, DataFrame, float]:
    """Left rows with the cells they visit, right rows with their own, both with the distance to its pivot, and the radius."""

    def unit(df: DataFrame, k: str, v: str) -> DataFrame:
        d = df.select(*by, F.col(key).alias(k), F.transform(F.col(vector), lambda x: x.cast("double")).alias(v))
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return d.withColumn("__n", size).filter("__n > 0").withColumn(v, F.transform(v, lambda x: x / F.nullif(F.col("__n"), F.lit(0.0)))).drop("__n")

    a, b = unit(left, "i", "__x"), unit(right, "j", "__y")
    chosen = [r[0] for r in b.orderBy(F.xxhash64("j"), "j").limit(pivots).select("__y").collect()] or [[1.0]]
    centres = F.array(*[F.array(*[F.lit(x) for x in p]) for p in chosen])
    radius = (2 - 2 * threshold) ** 0.5 + 1e-9
    apart = lambda v: F.transform(centres, lambda p: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with(v, p, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t))))
    b = b.withColumn("__d", apart(F.col("__y")))
    b = b.withColumn("__to", F.array_min("__d")).withColumn("__cell", (F.array_position("__d", F.col("__to")) - 1).cast("int")).drop("__d")
    reach = {r[0]: r[1] for r in b.groupBy("__cell").agg(F.max("__to")).collect()}
    most = F.array(*[F.lit(reach.get(k, -10.0)) for k in range(len(chosen))])
    a = a.withColumn("__d", apart(F.col("__x"))).withColumn("__low", F.array_min("__d"))
    cells = F.filter(
        F.transform("__d", lambda d, k: F.struct(k.alias("c"), d.alias("d"))),
        lambda s: (s["d"] <= F.get(most, s["c"]) + radius) & (s["d"] - F.col("__low") <= 2 * radius),
    )
    a = a.withColumn("__s", F.explode(cells)).select(*[F.col(c).alias(f"__l_{c}") for c in by], "i", "__x", F.col("__s.c").alias("__c"), F.col("__s.d").alias("__from"))
    return a, b, radius


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    return edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shared count, Jaccard index and containment of two sets of keys."""
    x = a.select(key).distinct().withColumn("__a", F.lit(1))
    y = b.select(key).distinct().withColumn("__b", F.lit(1))
    both = F.count("__both")
    df = x.join(y, key, "full").withColumn("__both", F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1))
    return df.agg(
        F.count("__a").alias("n_a"),
        F.count("__b").alias("n_b"),
        both.alias("shared"),
        (both / F.count(F.lit(1))).alias("jaccard"),
        (both / F.nullif(F.count("__a"), F.lit(0))).alias("a_in_b"),
        (both / F.nullif(F.count("__b"), F.lit(0))).alias("b_in_a"),
    )


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Dummy columns of all levels but the first in string order."""
    return df.withColumns({f"{col}_{v}": F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in sorted(levels)[1:]})


def column_changes(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """For each column the number of keys in both versions whose value differs."""
    o = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in cols])
    df = new.join(o, F.col(key) == F.col("__k"))
    one = df.agg(*[F.sum((~F.col(c).eqNullSafe(F.col(f"__{c}"))).cast("long")).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column", "changed")
