"""Mathematical functions that Spark lacks, as Column expressions where a closed form will do."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def log_gamma(x: Column) -> Column:
    """Natural log of the gamma function for x > 0: Stirling's series after a shift by eight."""
    x = x.cast("double")
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def log_choose(n: Column, k: Column) -> Column:
    """Natural log of n over k; null where it is zero."""
    ok = (k >= 0) & (k <= n)
    return F.when(ok, log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0))


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal distribution."""
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t distribution."""
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def bisect(f, lo: float, hi: float) -> float:
    """Root of a rising function on [lo, hi]."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t distribution for p > 0.5."""
    return bisect(lambda t: 1 - t_tail(t, df) / 2 - p, 0.0, 1e4)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval."""
    tail = (1 - level) / 2
    low = 0.0 if k == 0 else bisect(lambda p: beta_fraction(k, n - k + 1, p) - tail, 0.0, 1.0)
    high = 1.0 if k == n else bisect(lambda p: beta_fraction(k + 1, n - k, p) - (1 - tail), 0.0, 1.0)
    return low, high


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def exact_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact binomial interval of each count ``k`` of ``n``; null where there is none to count."""
    ends = [clopper_pearson(int(a), int(b)) if b > 0 else (None, None) for a, b in zip(k, n)]
    return pd.DataFrame(ends, columns=["low", "high"])
