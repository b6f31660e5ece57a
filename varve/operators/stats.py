"""Statistics from grouped sums; linear algebra on the driver is at most a few columns square."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.mathfn import log_choose, t_quantile
from varve.operators.windows import average_rank, over, ranked


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of each group over rows where both are known; null under three rows or without spread."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    df = ranked(ranked(df, x, by, "__x"), y, by, "__y")
    flat = (F.stddev_pop("__x") == 0) | (F.stddev_pop("__y") == 0) | (F.count(F.lit(1)) < 3)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(~flat, F.corr("__x", "__y")).alias("rho"))


def slope(x: str, y: str) -> Column:
    return F.regr_slope(F.col(y), F.col(x))


def permanova(df: DataFrame, unit: str, group: str, axis: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Pseudo-F of one factor from long coordinates (unit, axis, value)."""
    g = F.avg(value).over(over([*by, group, axis]))
    m = F.avg(value).over(over([*by, axis]))
    df = df.withColumns({"__w": F.pow(F.col(value) - g, 2), "__b": F.pow(g - m, 2)})
    out = df.groupBy(*by).agg(
        F.sum("__b").alias("ssb"), F.sum("__w").alias("ssw"), F.countDistinct(group).alias("k"), F.countDistinct(unit).alias("n")
    )
    return out.withColumn("pseudo_f", (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))


def moran(values: DataFrame, edges: DataFrame, unit: str, value: str) -> DataFrame:
    """Moran's I of one variable over unit-weight directed edges (i, j)."""
    mean = values.agg(F.avg(value).alias("__m"))
    z = values.crossJoin(F.broadcast(mean)).select(F.col(unit).alias("u"), (F.col(value) - F.col("__m")).alias("z"))
    zi, zj = z.select(F.col("u").alias("i"), F.col("z").alias("zi")), z.select(F.col("u").alias("j"), F.col("z").alias("zj"))
    top = edges.join(zi, "i").join(zj, "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("s"), F.count(F.lit(1)).alias("w"))
    low = z.agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.count(F.lit(1)).alias("n"))
    return top.crossJoin(low).select((F.col("n") / F.col("w") * F.col("s") / F.col("ss")).alias("moran_i"))


def wilcoxon_w(df: DataFrame, diff: str, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank statistic min(W+, W-) of non-zero differences."""
    d = df.filter(F.col(diff) != 0).withColumn("__a", F.abs(diff))
    d = ranked(d, "__a", by, "__r")
    plus = F.sum(F.when(F.col(diff) > 0, F.col("__r")).otherwise(0.0))
    minus = F.sum(F.when(F.col(diff) < 0, F.col("__r")).otherwise(0.0))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("w"))


def mann_whitney(df: DataFrame, group: str, value: str, first, by: Sequence[str] = ()) -> DataFrame:
    """U of the rows whose group equals ``first`` against the rest, with Cliff's delta."""
    r = ranked(df, value, by, "__r")
    n1 = F.count(F.when(F.col(group) == first, 1))
    n2 = F.count(F.when(F.col(group) != first, 1))
    u = F.sum(F.when(F.col(group) == first, F.col("__r"))) - n1 * (n1 + 1) / 2
    return r.groupBy(*by).agg(n1.alias("n1"), n2.alias("n2"), u.alias("u"), (2 * u / (n1 * n2) - 1).alias("cliffs_delta"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman's chi-square of complete blocks, uncorrected for ties."""
    r = df.withColumn("__r", average_rank(value, [block]))
    s = r.groupBy(treatment).agg(F.sum("__r").alias("r"), F.count(F.lit(1)).alias("n"))
    k, n = F.count(F.lit(1)), F.max("n")
    return s.agg(k.alias("k"), n.alias("n"), (12 / (n * k * (k + 1)) * F.sum(F.col("r") * F.col("r")) - 3 * n * (k + 1)).alias("chi2"))


def fisher_greater(a: str, b: str, c: str, d: str) -> Column:
    """One-sided Fisher exact p of the table [[a, b], [c, d]]: chance of a or more; one where a is zero."""
    row, col, n = F.col(a) + F.col(b), F.col(a) + F.col(c), F.col(a) + F.col(b) + F.col(c) + F.col(d)
    top = F.least(row, col)
    term = lambda x: F.exp(log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col))
    tail = F.aggregate(F.sequence(F.col(a), top), F.lit(0.0), lambda s, x: s + F.coalesce(term(x), F.lit(0.0)))
    return F.when(F.col(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def jackknife_se(values: str, estimate: Column | None = None) -> Column:
    """Delete-one standard error from the leave-one-out values, as an aggregate."""
    n = F.count(values)
    return F.sqrt((n - 1) / n * F.var_pop(values) * n)


def jackknife_interval(estimate: float, leave_one: Sequence[float], low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """Student interval of a delete-one jackknife, clipped to bounds."""
    v = np.asarray(leave_one, float)
    n = len(v)
    half = t_quantile(0.975, n - 1) * float(np.sqrt((n - 1) / n * ((v - v.mean()) ** 2).sum()))
    a, b = estimate - half, estimate + half
    return (a if low is None else max(a, low)), (b if high is None else min(b, high))


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of products of all column pairs (the upper triangle, named ``g_i_j``) and the row count, for each group."""
    pairs = combinations_with_replacement(range(len(cols)), 2)
    sums = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g_{i}_{j}") for i, j in pairs]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def _matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i, j in combinations_with_replacement(range(k), 2):
        m[i, j] = m[j, i] = row[f"g_{i}_{j}"] or 0.0
    return m


def ols(df: DataFrame, y: str, xs: Sequence[str], cluster: str | None = None) -> dict:
    """Least squares with an intercept; standard errors robust to clusters if one is named.

    Only the k x k sums and, for the sandwich, their aggregate over clusters
    reach the driver; rank deficiency is reported and solved by pseudo-inverse.
    """
    cols = ["__one", *xs, y]
    data = df.select(*([cluster] if cluster else []), *xs, y).dropna().withColumn("__one", F.lit(1.0))
    total = gram(data, cols).first()
    m, k, n = _matrix(total, len(cols)), len(cols) - 1, total["n"]
    xtx, xty = m[:k, :k], m[:k, k]
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ xty
    rss = float(m[k, k] - beta @ xty)
    rank = int(np.linalg.matrix_rank(xtx))
    out = {"beta": beta, "n": n, "rank": rank, "rss": rss}
    if cluster:
        fitted = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, cols)), F.lit(0.0))
        scored = data.withColumn("__e", F.col(y) - fitted)
        per = scored.groupBy(cluster).agg(*[F.sum(F.col("__e") * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols[:k])])
        meat_row = gram(per, [f"s{i}" for i in range(k)]).first()
        g = meat_row["n"]
        small = g / max(g - 1, 1) * (n - 1) / max(n - rank, 1)
        cov = inverse @ _matrix(meat_row, k) @ inverse * small
    else:
        cov = inverse * rss / max(n - rank, 1)
    out["se"] = np.sqrt(np.clip(np.diag(cov), 0, None))
    return out
