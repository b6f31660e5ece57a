"""Null distributions and refits: nested permutation tests, orbits, shift tuples, moving blocks, refit bootstraps and held-out skill.

Everything a draw needs is a grouped sum; what reaches the driver or one task is a
few numbers a draw or a matrix as wide as the model.  Draws come from hashes, as in
``resample``, or from a numbering of all cases that is never listed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.operators.resample import block_bootstrap, draws, hash_draw, permuted
from varve.operators.stats import _matrix, gram
from varve.operators.windows import global_places, over, prefix_sums


def _centred(c: Column, by: Sequence[str]) -> Column:
    return c - F.avg(c).over(over(by))


def nested_test(
    units: DataFrame, response: DataFrame, unit: str, stratum: str, factors: Sequence[str], predictor: str, axis: str, value: str, n: int, seed: int, most: int = 60
) -> DataFrame:
    """Partial R2, pseudo-F and permutation p of one predictor after strata and further factors.

    ``units`` has one row for each unit, ``response`` one for each (unit, axis).  What
    the reduced model leaves of the predictor is permuted within strata; a draw's F
    compares what it then explains with what it leaves.  Strata are removed by
    centring, however many there are; the dummies of the other factors, at most
    ``most``, make one small matrix on the driver.  F is null where the predictor
    lies in the reduced model.
    """
    levels = [(f, v) for f in factors for v in [r[0] for r in units.select(f).distinct().orderBy(f).limit(most + 2).collect()][1:]]
    if len(levels) > most:
        raise ValueError(f"more than {most} levels beside the strata")
    k, zs = len(levels), [f"__z{j}" for j in range(len(levels))]
    dummies = [_centred((F.col(f) == F.lit(v)).cast("double"), [stratum]).alias(z) for (f, v), z in zip(levels, zs)]
    base = units.select(unit, stratum, _centred(F.col(predictor).cast("double"), [stratum]).alias("__x"), *dummies)
    row = gram(base, [*zs, "__x"]).first()
    if not row["n"]:
        return units.sparkSession.createDataFrame([], "partial_r2 double, pseudo_f double, p double, residual_df long, draws long")
    m = _matrix(row, k + 1)
    inverse, strata = np.linalg.pinv(m[:k, :k]), base.select(stratum).distinct().count()
    free = row["n"] - strata - int(np.linalg.matrix_rank(m[:k, :k]) if k else 0) - 1
    left = F.col("__x") - sum((F.lit(float(b)) * F.col(z) for b, z in zip(inverse @ m[:k, k], zs)), F.lit(0.0))
    base = base.withColumn("__r", left)
    every = permuted(base, unit, "__r", n, seed, [stratum]).select("draw", F.col(unit).alias("__u"), "__r")
    every = every.unionByName(base.select(F.lit(-1).cast("long").alias("draw"), F.col(unit).alias("__u"), "__r"))
    every = every.join(base.select(unit, *zs), F.col(unit) == F.col("__u"))
    sums = every.groupBy("draw").agg(F.sum(F.col("__r") * F.col("__r")).alias("q"), *[F.sum(F.col("__r") * F.col(z)).alias(z) for z in zs]).collect()
    fitted = [(r["draw"], (inverse @ np.array([r[z] for z in zs])).tolist(), r["q"], np.array([r[z] for z in zs])) for r in sums]
    table = [(d, [float(x) for x in c], float(q - v @ np.array(c)) if k else float(q)) for d, c, q, v in fitted]
    coefs = units.sparkSession.createDataFrame(table, "__d long, __c array<double>, __q double")
    res = every.join(F.broadcast(coefs), F.col("draw") == F.col("__d"))
    res = res.withColumn("__r", F.col("__r") - sum((F.get("__c", F.lit(j)) * F.col(z) for j, z in enumerate(zs)), F.lit(0.0)))
    y = response.select(F.col(unit).alias("__w"), axis, F.col(value).cast("double").alias("__y"))
    shared = res.join(y, F.col("__u") == F.col("__w")).groupBy("draw", "__q", axis).agg(F.sum(F.col("__r") * F.col("__y")).alias("t"))
    effects = shared.groupBy("draw").agg((F.sum(F.col("t") * F.col("t")) / F.nullif(F.max("__q"), F.lit(0.0))).alias("effect"))
    flat = base.select(F.col(unit).alias("__u"), stratum, *zs).join(y, F.col("__u") == F.col("__w")).withColumn("__y", _centred(F.col("__y"), [stratum, axis]))
    per = flat.groupBy(axis).agg(F.sum(F.col("__y") * F.col("__y")).alias("__s"), *[F.sum(F.col("__y") * F.col(z)).alias(z) for z in zs])
    shares = [sum((F.lit(float(a)) * F.col(z) for a, z in zip(line, zs)), F.lit(0.0)) for line in _root(inverse)]
    sse = per.agg(F.sum(F.col("__s") - sum((c * c for c in shares), F.lit(0.0))).alias("sse"))
    f = F.col("effect") / ((F.col("sse") - F.col("effect")) / F.lit(float(max(free, 1))))
    scored = effects.crossJoin(F.broadcast(sse)).select("draw", (F.col("effect") / F.col("sse")).alias("r2"), f.alias("f"))
    seen = scored.filter("draw < 0").select(F.col("r2").alias("partial_r2"), F.col("f").alias("pseudo_f"))
    null = scored.filter("draw >= 0").select(F.col("f").alias("null"))
    hits = F.count_if(F.col("null") >= F.col("pseudo_f") - 1e-12)
    out = seen.join(F.broadcast(null), F.lit(True), "left").groupBy("partial_r2", "pseudo_f").agg(((1 + hits) / (1 + F.count("null"))).alias("p"), F.count("null").alias("draws"))
    return out.select("partial_r2", "pseudo_f", "p", F.lit(free).cast("long").alias("residual_df"), "draws")


def _root(m: np.ndarray) -> np.ndarray:
    """Rows r with m = r' r, for a symmetric matrix without negative values."""
    values, vectors = np.linalg.eigh(m) if len(m) else (np.zeros(0), np.zeros((0, 0)))
    keep = values > 1e-14 * max(values.max(initial=0.0), 1e-300)
    return (vectors[:, keep] * np.sqrt(values[keep])).T


def moving_blocks(df: DataFrame, order: str, sums: Sequence[str], length: int, n: int, seed: int) -> DataFrame:
    """For each draw the sums over enough blocks of ``length`` consecutive units to cover them all, overlapping and each begun by a hash.

    A block's sum is the difference of two prefix sums, so a draw costs two lookups
    a block, whatever the length.  A series shorter than ``length`` is one block.
    """
    ahead = prefix_sums(df, order, sums).select("__i", *sums)
    whole = df.agg(F.count(F.lit(1)).alias("__i"), *[F.sum(c).alias(c) for c in sums])
    size = whole.first()["__i"]
    if not size:
        return df.sparkSession.range(0).select(F.col("id").alias("draw"), *[F.lit(None).cast("double").alias(c) for c in sums])
    length = min(length, size)
    ahead = ahead.unionByName(whole.select("__i", *sums))
    slots = draws(df.sparkSession.range(-(-size // length)).select(F.col("id").alias("slot")), n)
    start = hash_draw(seed, "draw", "slot") % F.lit(size - length + 1)
    ends = slots.withColumn("__s", start).select("draw", F.explode(F.array(F.struct(F.lit(-1).alias("g"), F.col("__s").alias("i")), F.struct(F.lit(1).alias("g"), (F.col("__s") + length).alias("i")))).alias("e"))
    ends = ends.groupBy("draw", F.col("e.i").alias("__at")).agg(F.sum("e.g").alias("__g"))
    return ends.join(ahead, F.col("__at") == F.col("__i")).groupBy("draw").agg(*[F.sum(F.col("__g") * F.col(c)).alias(c) for c in sums])


def _solved(parts: Iterator[pd.DataFrame], fit) -> Iterator[pd.DataFrame]:
    for part in parts:
        if len(part):
            yield pd.DataFrame([x for row in part.itertuples(index=False) for x in fit(row)])


def refit_bootstrap(rows: DataFrame, cluster: str, y: str, candidates: Sequence[str], nuisance: Sequence[str], n: int, seed: int) -> DataFrame:
    """(draw, candidate, beta, rho, partial_r2) of each candidate regressor after an intercept and the nuisance ones, refitted on every resample of clusters.

    Draw -1 is the data.  A cluster is one row of sums of products; a draw's normal
    equations are those sums weighted by how often each cluster was drawn, and are
    solved next to them.  A candidate without spread left has no values.
    """
    zs = ["__one", *nuisance]
    data = rows.select(cluster, y, *candidates, *nuisance).dropna().withColumn("__one", F.lit(1.0))
    pairs = [(a, b) for a, b in combinations_with_replacement(zs, 2)]
    pairs += [(z, c) for z in zs for c in [*candidates, y]] + [(c, y) for c in candidates] + [(c, c) for c in [*candidates, y]]
    names = [f"s{i}" for i in range(len(pairs))]
    blocks = data.groupBy(cluster).agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(s) for (a, b), s in zip(pairs, names)])
    whole = blocks.agg(*[F.sum(s).alias(s) for s in names]).select(F.lit(-1).cast("long").alias("draw"), *names)
    every = whole.unionByName(block_bootstrap(blocks, cluster, names, n, seed))
    at = {p: i + 1 for i, p in enumerate(pairs)}

    def fit(row) -> list[tuple]:
        get = lambda a, b: row[at[a, b]]
        zz = np.array([[get(*((a, b) if (a, b) in at else (b, a))) for b in zs] for a in zs])
        inverse = np.linalg.pinv(zz)
        zy = np.array([get(z, y) for z in zs])
        yy = get(y, y) - zy @ inverse @ zy
        out = []
        for c in candidates:
            zx = np.array([get(z, c) for z in zs])
            xx, xy = get(c, c) - zx @ inverse @ zx, get(c, y) - zx @ inverse @ zy
            known = xx > 1e-12 * max(get(c, c), 1e-300) and yy > 1e-12 * max(get(y, y), 1e-300)
            rho = xy / math.sqrt(xx * yy) if known else None
            out.append({"draw": int(row[0]), "candidate": c, "beta": xy / xx if known else None, "rho": rho, "partial_r2": rho * rho if known else None})
        return out

    return every.mapInPandas(lambda parts: _solved(parts, fit), "draw long, candidate string, beta double, rho double, partial_r2 double")


def selected_refits(refits: DataFrame) -> DataFrame:
    """For each draw the candidate of the greatest correlation, chosen anew, with its values, and those of the candidate that the data choose."""
    best = F.max_by(F.struct("candidate", "beta", "partial_r2"), F.struct("rho", "candidate"))
    chosen = refits.filter("rho IS NOT NULL").groupBy("draw").agg(best.alias("b"))
    first = chosen.filter("draw < 0").select(F.col("b.candidate").alias("__first"))
    fixed = refits.join(F.broadcast(first), F.col("candidate") == F.col("__first")).select(F.col("draw").alias("__d"), F.col("beta").alias("fixed_beta"), F.col("partial_r2").alias("fixed_partial_r2"))
    out = chosen.join(fixed, F.col("draw") == F.col("__d"))
    return out.select("draw", F.col("b.candidate").alias("selected"), F.col("b.beta").alias("selected_beta"), F.col("b.partial_r2").alias("selected_partial_r2"), "fixed_beta", "fixed_partial_r2")


def weighted_refits(rows: DataFrame, block: str, ys: Sequence[str], xs: Sequence[str], weight: str, n: int, seed: int) -> DataFrame:
    """(draw, response, valid, beta_0 ...) of weighted least squares of several responses on common resamples of blocks; draw -1 is the data.

    All responses of a draw are fitted on the same blocks, so their differences are
    paired.  A draw whose design lost rank is marked and has no coefficients.
    """
    cols = ["__one", *xs]
    data = rows.select(block, weight, *xs, *ys).dropna().withColumn("__one", F.lit(1.0))
    pairs = [*combinations_with_replacement(cols, 2), *[(c, y) for c in cols for y in ys]]
    names = [f"s{i}" for i in range(len(pairs))]
    blocks = data.groupBy(block).agg(*[F.sum(F.col(weight) * F.col(a) * F.col(b)).alias(s) for (a, b), s in zip(pairs, names)])
    whole = blocks.agg(*[F.sum(s).alias(s) for s in names]).select(F.lit(-1).cast("long").alias("draw"), *names)
    every = whole.unionByName(block_bootstrap(blocks, block, names, n, seed))
    at = {p: i + 1 for i, p in enumerate(pairs)}

    def fit(row) -> list[dict]:
        m = np.array([[row[at[(a, b) if (a, b) in at else (b, a)]] for b in cols] for a in cols])
        scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        valid = int(np.linalg.matrix_rank(m / np.outer(scale, scale), tol=1e-9)) == len(cols)
        out = []
        for y in ys:
            beta = np.linalg.solve(m, np.array([row[at[c, y]] for c in cols])) if valid else [None] * len(cols)
            out.append({"draw": int(row[0]), "response": y, "valid": valid} | {f"beta_{j}": None if b is None else float(b) for j, b in enumerate(beta)})
        return out

    kinds = "draw long, response string, valid boolean" + "".join(f", beta_{j} double" for j in range(len(cols)))
    return every.mapInPandas(lambda parts: _solved(parts, fit), kinds)


def unranked(number: Column, n: int) -> Column:
    """The permutation of 0 .. n - 1 with a given number, as an array: each factorial digit picks from what is left."""

    def pick(state: Column, k: Column) -> Column:
        base = F.element_at(F.array(*[F.lit(math.factorial(j)) for j in range(n)]), F.lit(n) - k)
        digit = F.floor(state["rest"] / base).cast("int")
        return F.struct(
            F.concat(state["out"], F.slice(state["left"], digit + 1, F.lit(1))).alias("out"),
            F.concat(F.slice(state["left"], F.lit(1), digit), F.slice(state["left"], digit + 2, F.lit(n))).alias("left"),
            (state["rest"] % base).alias("rest"),
        )

    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("out"), F.sequence(F.lit(0), F.lit(n - 1)).alias("left"), number.cast("long").alias("rest"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, pick, lambda s: s["out"])


def permutation_orbit(cross: DataFrame, most: int = 12, digits: int = 6) -> DataFrame:
    """(number, mapping, stat, p): all assignments of n columns to n rows with the sum of their ``cross(i, j, value)`` and its exact upper-tail p.

    The n! assignments are a range of numbers from which each is unranked, so they are
    spread over tasks and never listed; n is checked.  p is the share of the orbit
    that is at least as large, counted by ranges of the rounded statistic.
    """
    table = {(r["i"], r["j"]): float(r["value"]) for r in cross.limit(most * most + 1).collect()}
    names = sorted({i for i, _ in table} | {j for _, j in table})
    n = len(names)
    if n > most:
        raise ValueError(f"at most {most} rows and columns")
    spark = cross.sparkSession
    if not n:
        return spark.createDataFrame([], "number long, mapping string, stat double, p double")
    values = F.array(*[F.lit(table.get((i, j), 0.0)) for i in names for j in names])
    total = math.factorial(n)
    tasks = max(1, min(total // 5000, 10_000))
    df = spark.range(0, total, 1, tasks).select(F.col("id").alias("number"), unranked(F.col("id"), n).alias("__m"))
    terms = F.transform("__m", lambda j, i: F.get(values, i * n + j))
    stat = F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), digits)
    df = df.select("number", F.array_join("__m", ",").alias("mapping"), stat.alias("stat"))
    above = global_places(df, "stat").select("__v", ((F.lit(total) - F.col("__below")) / F.lit(float(total))).alias("p"))
    return df.join(above, F.col("stat") == F.col("__v")).drop("__v")


def scrambled(number: Column, bits: int, seed: int) -> Column:
    """A bijection of the numbers under 4 ** bits: four rounds that swap halves and add a hash of one to the other."""
    last = (1 << bits) - 1
    high, low = F.shiftright(number, bits), number.bitwiseAND(F.lit(last))
    for k in range(4):
        high, low = low, (high + hash_draw(seed, F.lit(k), low)).bitwiseAND(F.lit(last))
    return F.shiftleft(high, bits) + low


def distinct_tuples(spark: SparkSession, radices: Sequence[int], n: int, seed: int) -> DataFrame:
    """(draw, digits): the first ``n`` distinct tuples of a fixed random order of all tuples with digits under ``radices``, the zero tuple left out.

    Numbers are scrambled by a bijection, so no tuple can come twice and none is
    remembered; those beyond the last tuple are passed over.
    """
    total = math.prod(radices)
    bits = max(1, -(-max(1, (total - 1).bit_length()) // 2))
    if bits > 31:
        raise ValueError("too many tuples to number")
    domain = 4**bits
    # of the numbers looked at, total / domain are tuples; enough for n of them and ten standard deviations
    share = total / domain
    look = min(domain, int((n + 1 + 10 * math.sqrt(n + 1)) / share) + 64)
    df = spark.range(look).select(F.col("id").alias("k"), scrambled(F.col("id"), bits, seed).alias("__t")).filter((F.col("__t") < total) & (F.col("__t") > 0))
    bases = [math.prod(radices[j + 1 :]) for j in range(len(radices))]
    digits = F.array(*[F.floor(F.col("__t") / b).cast("long") % r for b, r in zip(bases, radices)])
    return prefix_sums(df, "k", []).join(df.withColumn("digits", digits).select(F.col("k").alias("__k"), "digits"), F.col("k") == F.col("__k")).filter(F.col("__i") < n).select(F.col("__i").alias("draw"), "digits")


def shift_null(pieces: DataFrame, tuples: DataFrame, groups: Sequence, lags: int, tol: float = 1e-9) -> DataFrame:
    """(draw, rank, top, r_0 ...): for each tuple of shifts, one for each group, the correlations of a response with ``lags`` exposures.

    ``pieces`` has the sums of each (group, shift): ``yy``, ``xy_l`` and ``xx_l_m``,
    what is to be removed already removed; a tuple adds one row of each group.  ``rank``
    is that of the exposures' products, so tuples that cannot be estimated can be told;
    ``top`` is the greatest absolute correlation.
    """
    sums = ["yy", *[f"xy_{j}" for j in range(lags)], *[f"xx_{i}_{j}" for i, j in combinations_with_replacement(range(lags), 2)]]
    each = tuples.select("draw", F.posexplode("digits").alias("__g", "__shift"))
    names = F.array(*[F.lit(g) for g in groups])
    met = each.withColumn("__group", F.get(names, F.col("__g"))).join(pieces, (F.col("__group") == F.col("group")) & (F.col("__shift") == F.col("shift")))
    per = met.groupBy("draw").agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(groups)).drop("__n")

    def fit(row) -> list[dict]:
        v = row._asdict()
        g = np.array([[v[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(lags)] for i in range(lags)])
        scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        rank = int(np.linalg.matrix_rank(g / np.outer(scale, scale), tol=tol))
        r = [v[f"xy_{j}"] / math.sqrt(g[j, j] * v["yy"]) if g[j, j] > 0 and v["yy"] > 0 else None for j in range(lags)]
        return [{"draw": int(v["draw"]), "rank": rank, "top": max((abs(x) for x in r if x is not None), default=None)} | {f"r_{j}": x for j, x in enumerate(r)}]

    kinds = "draw long, rank int, top double" + "".join(f", r_{j} double" for j in range(lags))
    return per.mapInPandas(lambda parts: _solved(parts, fit), kinds)


def redundancy_null(abundance: DataFrame, annotation: DataFrame, sample: str, feature: str, trait: str, value: str, n: int, seed: int) -> DataFrame:
    """(draw, median): the median dissimilarity of the samples' trait profiles, with the annotation as it is (draw -1) and with features relabelled by a keyed permutation each draw.

    A feature takes over all traits of the one that its draw assigns to it.  Profiles
    and pairs of all draws are one join and sum each.
    """
    features = abundance.select(feature).distinct().withColumn("__label", F.col(feature))
    many = permuted(features, feature, "__label", n, seed).select("draw", feature, "__label")
    many = many.unionByName(features.select(F.lit(-1).cast("long").alias("draw"), feature, "__label"))
    ann = annotation.select(F.col(feature).alias("__f"), trait)
    profile = abundance.join(many, feature).join(ann, F.col("__label") == F.col("__f")).groupBy("draw", sample, trait).agg(F.sum(value).alias("__v"))
    total = profile.groupBy("draw", sample).agg(F.sum("__v").alias("__t"))
    a = profile.select("draw", F.col(sample).alias("i"), F.col(trait).alias("t"), F.col("__v").alias("vi"))
    b = profile.select(F.col("draw").alias("d"), F.col(sample).alias("j"), F.col(trait).alias("u"), F.col("__v").alias("vj"))
    both = a.join(b, (F.col("draw") == F.col("d")) & (F.col("t") == F.col("u")) & (F.col("i") < F.col("j"))).groupBy("draw", "i", "j").agg(F.sum(F.least("vi", "vj")).alias("s"))
    x = total.select("draw", F.col(sample).alias("i"), F.col("__t").alias("ti"))
    y = total.select(F.col("draw").alias("d"), F.col(sample).alias("j"), F.col("__t").alias("tj"))
    grid = x.join(y, (F.col("draw") == F.col("d")) & (F.col("i") < F.col("j"))).drop("d").join(both, ["draw", "i", "j"], "left")
    bray = 1 - 2 * F.coalesce("s", F.lit(0)) / F.nullif(F.col("ti") + F.col("tj"), F.lit(0))
    return grid.withColumn("bray", bray.cast("double")).groupBy("draw").agg(F.median("bray").alias("median"))


def held_out_skill(
    counts: DataFrame, block: str, campaign: str, stratum: str, unit: str, feature: str, value: str, position: str, taxa: int, prevalence: float, pseudocount: float = 0.5, most: int = 10_000
) -> DataFrame:
    """(block, campaign, pairs, sse, sst, skill) of each fold of a quadratic trend along ``position``, everything learnt from the fold's other blocks and campaigns.

    ``counts`` is dense: one row for each (campaign, stratum, unit, feature).  A fold
    leaves out one block in one campaign and learns from the rows of neither.  Which
    features have the prevalence and are the ``taxa`` most abundant follows from
    sums by (block, campaign), the whole less what is left out.  Positions are scaled
    and responses centred within (campaign, stratum) by the training rows alone.
    Held-out pairs of units of one (campaign, stratum) are scored in closed form:
    the squared differences of all pairs are n times the squares less the squared sum.
    """
    c = counts.select(*[F.col(x).alias(y) for x, y in ((block, "b"), (campaign, "c"), (stratum, "s"), (unit, "u"), (feature, "f"), (position, "x"), (value, "v"))])
    cells = c.groupBy("b", "c", "f").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("v") > 0).cast("long")).alias("k"), F.sum("v").alias("v"))
    folds = c.select("b", "c").distinct().select(F.col("b").alias("fb"), F.col("c").alias("fc"))
    if folds.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} folds")
    sides = lambda t: (F.col("b") != F.col("fb")) & (F.col("c") != F.col("fc")) if t else (F.col("b") == F.col("fb")) & (F.col("c") == F.col("fc"))
    learnt = cells.join(F.broadcast(folds), sides(True)).groupBy("fb", "fc", "f").agg((F.sum("k") / F.sum("n")).alias("p"), F.sum("v").alias("v")).filter(F.col("p") >= prevalence)
    place = F.row_number().over(over(["fb", "fc"], F.col("v").desc(), "f"))
    chosen = learnt.withColumn("__n", place).filter(F.col("__n") <= taxa).select("fb", "fc", "f")
    ratio = F.log(F.col("v") + pseudocount)
    rows = c.join(F.broadcast(chosen), "f").filter(sides(True) | sides(False))
    rows = rows.withColumn("y", ratio - F.avg(ratio).over(over(["fb", "fc", "c", "s", "u"]))).withColumn("held", sides(False))
    marks = rows.filter("NOT held").select("fb", "fc", "c", "s", "u", "x").distinct().groupBy("fb", "fc").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).filter("sd > 0")
    z = (F.col("x") - F.col("m")) / F.col("sd")
    rows = rows.join(F.broadcast(marks), ["fb", "fc"]).withColumns({"z": z, "q": z * z})
    train = rows.filter("NOT held")
    near = ["fb", "fc", "c", "s", "f"]
    train = train.select("fb", "fc", "f", *[_centred(F.col(k), near).alias(k) for k in ("z", "q", "y")])
    s = train.groupBy("fb", "fc", "f").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("zz", "qq", "zq", "zy", "qy")])
    det = F.col("zz") * F.col("qq") - F.col("zq") * F.col("zq")
    sure = det > 1e-9 * F.col("zz") * F.col("qq")
    b0, b1 = (F.col("qq") * F.col("zy") - F.col("zq") * F.col("qy")) / det, (F.col("zz") * F.col("qy") - F.col("zq") * F.col("zy")) / det
    fit = s.filter(sure).select("fb", "fc", "f", b0.alias("b0"), b1.alias("b1"))
    held = rows.filter("held").join(F.broadcast(fit), ["fb", "fc", "f"])
    held = held.withColumn("e", F.col("y") - F.col("b0") * F.col("z") - F.col("b1") * F.col("q"))
    n = F.count(F.lit(1))
    scatter = lambda k: (n * F.sum(F.col(k) * F.col(k)) - F.sum(k) * F.sum(k)).alias(f"s_{k}")
    per = held.groupBy("fb", "fc", "s", "f").agg(n.alias("n"), scatter("e"), scatter("y"))
    pairs = per.groupBy("fb", "fc", "s").agg(F.max(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("s_e").alias("sse"), F.sum("s_y").alias("sst"))
    out = pairs.groupBy(F.col("fb").alias("block"), F.col("fc").alias("campaign")).agg(F.sum("pairs").cast("long").alias("pairs"), F.sum("sse").alias("sse"), F.sum("sst").alias("sst"))
    return out.filter("pairs > 0 AND sst > 0").withColumn("skill", 1 - F.col("sse") / F.col("sst"))


def pooled_skill(folds: DataFrame) -> DataFrame:
    """(folds, pooled, equal_weight): skill over all held-out pairs, and the mean of the folds'."""
    return folds.agg(F.count(F.lit(1)).alias("folds"), (1 - F.sum("sse") / F.sum("sst")).alias("pooled"), F.avg("skill").alias("equal_weight"))
