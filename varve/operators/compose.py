"""Compositional transforms, diversity and dissimilarity on long (sample, feature, count) tables.

Zeros are implicit.  Where a formula needs them (log ratios, distances) the
table is made dense over the *selected* features only, which is a small table
joined to the samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.functions.mathfn import log_choose
from varve.operators.windows import over


def closure(value: str, sample: Sequence[str]) -> Column:
    """Share of the sample's total; null for an empty sample."""
    return F.col(value) / F.nullif(F.sum(value).over(over(sample)), F.lit(0))


def densify(df: DataFrame, sample: Sequence[str], feature: str, value: str, features: DataFrame) -> DataFrame:
    """One row for every sample and selected feature, zero where nothing was counted."""
    grid = df.select(*sample).distinct().crossJoin(features.select(feature).distinct())
    return grid.join(df.select(*sample, feature, value), [*sample, feature], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def clr(df: DataFrame, sample: Sequence[str], value: str, pseudocount: float = 0.5, out: str = "clr") -> DataFrame:
    """Centred log ratio of a dense table: log(c + p) less its mean over the sample."""
    df = df.withColumn("__l", F.log(F.col(value) + F.lit(pseudocount)))
    return df.withColumn(out, F.col("__l") - F.avg("__l").over(over(sample))).drop("__l")


def clr_replaced(df: DataFrame, sample: Sequence[str], value: str, share: float = 0.65, out: str = "clr") -> DataFrame:
    """Centred log ratio after multiplicative replacement: zeros become share/total, the rest shrinks to close the sum."""
    total = F.sum(value).over(over(sample))
    zeros = F.sum((F.col(value) == 0).cast("int")).over(over(sample))
    delta = F.lit(share) / total
    p = F.when(F.col(value) == 0, delta).otherwise(F.col(value) / total * (1 - zeros * delta))
    df = df.withColumn("__l", F.log(p))
    return df.withColumn(out, F.col("__l") - F.avg("__l").over(over(sample))).drop("__l")


def clr_adaptive(df: DataFrame, sample: Sequence[str], value: str, out: str = "clr") -> DataFrame:
    """Centred log ratio with pseudocount 1 where the table holds counts (largest over 100), else 1e-6."""
    top = df.agg(F.max(value).alias("__m"))
    df = df.crossJoin(F.broadcast(top))
    df = df.withColumn("__l", F.log(F.col(value) + F.when(F.col("__m") > 100, 1.0).otherwise(1e-6)))
    return df.withColumn(out, F.col("__l") - F.avg("__l").over(over(sample))).drop("__l", "__m")


def guild_log_ratio(value: str, member: Column, pseudocount: float = 0.5) -> Column:
    """Log of the guild's total over all else, as an aggregate."""
    inside = F.sum(F.when(member, F.col(value)).otherwise(0))
    return F.log(inside + pseudocount) - F.log(F.sum(value) - inside + pseudocount)


def shannon(value: str) -> Column:
    """Shannon entropy as an aggregate; null for an empty sample."""
    c = F.when(F.col(value) > 0, F.col(value))
    n = F.sum(c)
    return F.log(n) - F.sum(c * F.log(c)) / n


def hill1(value: str) -> Column:
    return F.exp(shannon(value))


def richness(value: str) -> Column:
    return F.count(F.when(F.col(value) > 0, 1))


def alpha_diversity(df: DataFrame, sample: Sequence[str], value: str) -> DataFrame:
    """Depth, richness, entropy and evenness of every sample in one aggregate."""
    out = df.groupBy(*sample).agg(
        F.sum(value).alias("depth"), richness(value).alias("richness"), shannon(value).alias("shannon")
    )
    return out.withColumn("pielou", F.when(F.col("richness") > 1, F.col("shannon") / F.log("richness")))


def expected_richness(df: DataFrame, sample: Sequence[str], value: str, depth: int) -> DataFrame:
    """Hurlbert's expected richness at ``depth``; null where the sample is smaller."""
    n = F.sum(value).over(over(sample))
    d = F.lit(float(depth))
    absent = F.when(n - F.col(value) < depth, 0.0).otherwise(F.exp(log_choose(n - F.col(value), d) - log_choose(n.cast("double"), d)))
    df = df.filter(F.col(value) > 0).withColumns({"__n": n, "__t": 1 - absent})
    out = df.groupBy(*sample).agg(F.max("__n").alias("depth"), F.sum("__t").alias("__e"))
    return out.select(*sample, "depth", F.when(F.col("depth") >= depth, F.col("__e")).alias("expected_richness"))


def rarefied_counts(df: DataFrame, sample: Sequence[str], feature: str, value: str, depth: int, draws: int, seed: int) -> DataFrame:
    """Counts of ``depth`` reads drawn without replacement, for each draw; zero and null counts hold no read.

    Each read has an exponential key and the ``depth`` least keys of a sample are
    its subsample, which is hypergeometric.  Only keys below a level that about
    ``depth`` reads of the sample lie under are made: the i-th least of the c keys
    of a feature is the one before plus an exponential divided by c - i + 1, taken
    from an MD5 of (seed, draw, sample, feature, i).  Level and number of keys lie
    ten standard deviations above what is needed, so rows go with the depth, not
    with the reads, and results repeat on any cluster.
    """
    counts = df.filter(F.col(value) > 0).select(*sample, feature, F.col(value).cast("long").alias("__c"))
    total = F.sum("__c").over(over(sample)).cast("double")
    share = (F.lit(float(depth)) + 10 * F.sqrt(F.lit(float(depth))) + 20) / total
    level = F.when(share < 1, -F.log(1 - share))
    most = F.col("__c") * share
    keys = F.when(share < 1, F.least(F.col("__c"), F.ceil(most + 10 * F.sqrt(most) + 20))).otherwise(F.col("__c"))
    reads = counts.withColumns({"__level": level, "__keys": keys}).crossJoin(F.broadcast(df.sparkSession.range(draws).select(F.col("id").alias("draw"))))
    reads = reads.withColumn("read", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__keys"))))
    text = F.concat_ws("|", F.lit(str(seed)), "draw", *sample, feature, "read")
    u = (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    step = -F.log(u) / (F.col("__c") - F.col("read") + 1)
    key = F.sum(step).over(over([*sample, feature, "draw"], "read").rowsBetween(Window.unboundedPreceding, 0))
    kept = reads.withColumn("__key", key).filter(F.col("__level").isNull() | (F.col("__key") <= F.col("__level")))
    place = F.row_number().over(over([*sample, "draw"], "__key", feature, "read"))
    return kept.withColumn("__place", place).filter(F.col("__place") <= depth).groupBy(*sample, "draw", feature).agg(F.count(F.lit(1)).alias(value))


def bray_curtis(df: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """Dissimilarity of all unordered sample pairs and its balanced and gradient parts.

    Shared abundance comes from a sparse join on the feature; pairs that share
    nothing come from the pair grid of sample totals.
    """
    total = df.groupBy(sample).agg(F.sum(value).alias("total"))
    a = total.select(F.col(sample).alias("i"), F.col("total").alias("ti"))
    b = total.select(F.col(sample).alias("j"), F.col("total").alias("tj"))
    x = df.select(F.col(sample).alias("i"), F.col(feature).alias("f"), F.col(value).alias("vi"))
    y = df.select(F.col(sample).alias("j"), F.col(feature).alias("g"), F.col(value).alias("vj"))
    both = x.join(y, (F.col("f") == F.col("g")) & (F.col("i") < F.col("j"))).groupBy("i", "j").agg(F.sum(F.least("vi", "vj")).alias("s"))
    grid = a.join(b, F.col("i") < F.col("j")).join(both, ["i", "j"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    least = F.least(F.col("ti") - F.col("s"), F.col("tj") - F.col("s"))
    bray = F.coalesce(1 - 2 * F.col("s") / F.nullif(F.col("ti") + F.col("tj"), F.lit(0)), F.lit(0.0))
    balanced = F.coalesce(least / F.nullif(F.col("s") + least, F.lit(0)), F.lit(0.0))
    return grid.select("i", "j", bray.alias("bray"), balanced.alias("balanced"), (bray - balanced).alias("gradient"))


def sorensen(df: DataFrame, sample: str, feature: str) -> DataFrame:
    """Sorensen dissimilarity of sample pairs with its turnover and nestedness parts, from presence."""
    seen = df.select(F.col(sample).alias("s"), F.col(feature).alias("f")).distinct()
    n = seen.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select(F.col("s").alias("i"), F.col("n").alias("ni")), n.select(F.col("s").alias("j"), F.col("n").alias("nj"))
    x, y = seen.select(F.col("s").alias("i"), "f"), seen.select(F.col("s").alias("j"), F.col("f").alias("g"))
    both = x.join(y, (F.col("f") == F.col("g")) & (F.col("i") < F.col("j"))).groupBy("i", "j").agg(F.count(F.lit(1)).alias("s"))
    grid = a.join(b, F.col("i") < F.col("j")).join(both, ["i", "j"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    p, q = F.col("ni") - F.col("s"), F.col("nj") - F.col("s")
    whole = F.coalesce((p + q) / F.nullif(2 * F.col("s") + p + q, F.lit(0)), F.lit(0.0))
    turn = F.coalesce(F.least(p, q) / F.nullif(F.col("s") + F.least(p, q), F.lit(0)), F.lit(0.0))
    return grid.select("i", "j", whole.alias("sorensen"), turn.alias("turnover"), (whole - turn).alias("nestedness"))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v))


def trait_turnover(df: DataFrame, group: str, trait: str, target: str, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """Change of a weighted trait between two visits, split into between-group, within-group and exclusive parts, for each of ``by``.

    ``df`` holds one row for each member with its group, trait value and weight
    in either visit (columns ``target`` and ``reference``).
    """
    m = df.groupBy(*by, group).agg(
        F.sum(target).alias("ma"),
        F.sum(reference).alias("mb"),
        (F.sum(F.col(target) * F.col(trait)) / F.nullif(F.sum(target), F.lit(0))).alias("ta"),
        (F.sum(F.col(reference) * F.col(trait)) / F.nullif(F.sum(reference), F.lit(0))).alias("tb"),
    )
    shared = (F.col("ma") > 0) & (F.col("mb") > 0)
    ma, mb, ta, tb = (F.col(c) for c in ("ma", "mb", "ta", "tb"))
    value = lambda m_, t_: F.coalesce(m_ * t_, F.lit(0.0))
    return m.groupBy(*by).agg(
        F.sum(F.when(shared, (ma - mb) * (ta + tb) / 2).otherwise(0.0)).alias("between"),
        F.sum(F.when(shared, (ta - tb) * (ma + mb) / 2).otherwise(0.0)).alias("within"),
        F.sum(F.when(~shared, value(ma, ta) - value(mb, tb)).otherwise(0.0)).alias("exclusive"),
        F.sum(value(ma, ta) - value(mb, tb)).alias("total"),
    )
