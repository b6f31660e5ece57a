"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key divided by its quality weight, so that
the documents of a source in key order are a weighted sample at every length
(Efraimidis and Spirakis).  A source whose target is ``e`` times its size and a
rest takes ``e`` complete epochs first; the rest is the prefix of the key order
whose summed size is nearest to it.

The prefix sum is distributed.  A source's keys are exponentials whose rates are
the quality weights, so the share of its documents that lie under a key is known
from how many documents have which weight; cut at equal shares, its key ranges
hold about RANGE documents each, whatever the weights are.  Sizes are summed by
(source, range) before anything is ordered, only the documents of one range are
ordered together, and equal rows are one row with a count.  ``mix`` needs no order
at all: what a source takes is what lies at or under one key.

Edge cases: a null text has size zero and is taken zero words; a null source is
a source of its own, last in order; repeated rows draw the same key and follow
one another (``mix`` takes all or none of them); a null ``doc_id`` is drawn by its text; no rows give no rows; a
corpus without words has targets of zero.  Columns other than the four named
ones are ignored here and pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.llm.durable import bounded, durable
from varve.llm.words import SYMBOLS_RATIO_CHARS, unused, without, word_count

RANGE = 4096
LEVELS = 10
SOURCES = 10_000
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for clean text, less for each symbol or exclamation mark a word, never under 0.1."""
    body = F.coalesce(text, F.lit(""))
    odd = F.length(body) - F.length(without(body, SYMBOLS_RATIO_CHARS))
    return F.greatest(F.lit(0.1), F.lit(1.0) - odd / F.greatest(size, F.lit(1)))


def uniform(seed: str, *cols: Column) -> Column:
    """A number in (0, 1] from the first 48 bits of an MD5 of the seed and the columns as text."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 1.0) / F.lit(float(1 << 48))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, quality weight and exponential key of every document."""
    df = docs.select("doc_id", "source", "text").withColumn("size", word_count(F.col("text")))
    draw = F.when(F.col("doc_id").isNull(), uniform(seed, F.md5(F.coalesce("text", F.lit(""))))).otherwise(
        uniform(seed, F.col("doc_id"))
    )
    df = df.withColumn("weight", quality_weight(F.col("text"), F.col("size")))
    return df.select(
        "doc_id",
        "source",
        "size",
        "weight",
        (-F.log(draw) / F.col("weight")).alias("key"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )


def ranges(rows: DataFrame) -> DataFrame:
    """(source_key, shares, ranges): for each source the share of documents of each weight level, and in how many ranges its keys fall."""
    level = [F.sum(F.when(F.round(F.col("weight") * LEVELS) == k, F.col("n")).otherwise(0)) for k in range(1, LEVELS + 1)]
    shares = F.array(*[(x / F.sum("n")).cast("double") for x in level])
    return rows.groupBy(F.col("source_key").alias("s")).agg(shares.alias("shares"), F.ceil(F.sum("n") / RANGE).alias("ranges"))


def source_targets(sizes: DataFrame, max_epochs: float = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """Target words of each source, from one row (source, source_size) for each.

    Water filling: sources in order of ``max_epochs * size / weight`` are full
    while the level that the rest would get is above theirs.  The windows run
    over one row for each source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w)
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    df = df.withColumn(
        "level",
        (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the level of the first source in that order that is not full holds for all after it
    first = F.min(F.when(fits.isNotNull(), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(whole)
    level = first["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return df.select("source", "source_size", target.alias("target"))


def placed(docs: DataFrame, seed: str, max_epochs: float, weights) -> DataFrame:
    """Distinct rows with how many there are (n), their source's size and target, whole epochs, and how many of the n are taken once more."""
    base = sized(docs, seed).withColumn("source_key", F.xxhash64("source", F.col("source").isNull()))
    one = ["source_key", "source", "key", "doc_id", "size", "text_hash", "weight"]
    base = durable(base.groupBy(*one).agg(F.count(F.lit(1)).alias("n")))
    base = base.join(ranges(base), F.xxhash64("source_key") == F.xxhash64("s")).drop("s")
    beyond = F.aggregate(
        F.transform("shares", lambda x, i: x * F.exp(-F.col("key") * (i + 1) / LEVELS)), F.lit(0.0), lambda a, x: a + x
    )
    bucket = F.least(F.col("ranges") - 1, F.floor((1 - beyond) * F.col("ranges")))
    base = base.withColumn("bucket", F.greatest(F.lit(0), bucket).cast("int")).drop("shares", "ranges")
    sums = base.groupBy("source_key", "bucket").agg(
        F.max("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("bucket_size")
    )
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_epochs, weights)
    t = targets.select(F.xxhash64("source", F.col("source").isNull()).alias("source_key"), "source_size", "target")
    offset = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "source_key", "bucket", F.coalesce(F.sum("bucket_size").over(offset), F.lit(0)).alias("bucket_offset")
    ).join(t, "source_key")
    inside = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("key", "doc_id", "size", "text_hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    df = base.withColumn("before_in_bucket", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).join(
        sums, ["source_key", "bucket"]
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    df = df.withColumn("epochs", F.least(F.lit(int(max_epochs)), F.floor(ratio + 1e-9)).cast("int"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size") - F.col("bucket_offset") - F.col("before_in_bucket")
    # the k-th of n equal rows is taken while what comes before it and half of it fit the rest
    more = F.when((F.col("size") > 0) & (F.col("epochs") < int(max_epochs)), F.floor(rest / F.col("size") + 0.5)).otherwise(0)
    return df.withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), more)).cast("long"))


def draws(docs: DataFrame, seed: str = SEED, max_epochs: float = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """Every document with its size, its source's size and target, and how often it is taken."""
    df = placed(docs, seed, max_epochs, weights)
    block = F.lit(RANGE).cast("long")
    df = df.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    df = df.withColumn("__i", F.explode(F.sequence(F.col("__b") * block + 1, F.least(F.col("n"), (F.col("__b") + 1) * block))))
    times = F.col("epochs") + (F.col("__i") <= F.col("more")).cast("int")
    return df.select("doc_id", "source", "text_hash", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, seed: str = SEED, max_epochs: float = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns it came with.

    One row for each source tells the epochs and the last key taken beyond them;
    up to SOURCES of them are broadcast, so texts meet no shuffle.
    """
    df = placed(docs, seed, max_epochs, weights)
    order = ["key", "doc_id", "size", "text_hash"]
    cut = F.max(F.when(F.col("more") > 0, F.struct(*order)))
    cuts = df.groupBy("source_key").agg(F.max("epochs").alias("epochs"), cut.alias("cut"))
    own = unused(docs.columns, "__size", "__key", "__source", "__epochs", "__cut", "__copy")
    size, key, source, epochs, cut, copy = own
    cuts = cuts.select(F.col("source_key").alias(source), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    body = F.coalesce("text", F.lit(""))
    draw = F.when(F.col("doc_id").isNull(), uniform(seed, F.md5(body))).otherwise(uniform(seed, F.col("doc_id")))
    df = docs.withColumn(size, word_count(F.col("text"))).withColumn(key, -F.log(draw) / quality_weight(F.col("text"), F.col(size)))
    cuts, _ = bounded(cuts, SOURCES)
    df = df.join(cuts, F.xxhash64("source", F.col("source").isNull()) == F.col(source))
    here = F.struct(F.col(key).alias("key"), F.col("doc_id").alias("doc_id"), F.col(size).alias("size"), F.xxhash64(body).alias("text_hash"))
    times = F.col(epochs) + F.coalesce((F.col(size) > 0) & (here <= F.col(cut)), F.lit(False)).cast("int")
    df = df.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return df.select(*[f"`{c}`" for c in docs.columns])
