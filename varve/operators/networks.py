"""Association networks of features: penalty calibrated against permuted tables, edges kept by resampled sites.

Values are log ratios centred within campaigns.  Correlations of all refits are
grouped sums: of sites' products weighted by how often a site was drawn, or of
values permuted over the units of a campaign.  A network is one penalised
regression a feature on all others (neighbourhood selection); a task gets the
correlations of one refit, as wide as the selected features, and some of its features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators.compose import clr
from varve.operators.resample import draws, hash_draw
from varve.operators.windows import indexed, over

CHUNK = 32
KEYS = ["kind", "draw", "compartment"]


def centred_ratios(counts: DataFrame, compartment: str, campaign: str, site: str, feature: str, value: str, pseudocount: float = 0.5) -> DataFrame:
    """(compartment, campaign, site, f, v): log ratios of a dense table less their mean over the campaign's sites in the compartment."""
    df = clr(counts, [compartment, campaign, site], value, pseudocount)
    mean = F.avg("clr").over(over([compartment, campaign, feature]))
    return df.select(F.col(compartment).alias("compartment"), F.col(campaign).alias("campaign"), F.col(site).alias("site"), F.col(feature).alias("f"), (F.col("clr") - mean).alias("v"))


def _products(z: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over units of the values and products of each pair of features i <= j, by ``by``."""
    unit = ["compartment", "campaign", "site", *[c for c in by if c == "draw"]]
    a = z.select(*unit, F.col("f").alias("i"), F.col("v").alias("vi"))
    b = z.select(*unit, F.col("f").alias("j"), F.col("v").alias("vj"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("vi").alias("si"), F.sum("vj").alias("sj"), F.sum(F.col("vi") * F.col("vj")).alias("sij")]
    return a.join(b, unit).filter("i <= j").groupBy(*by, "i", "j").agg(*sums)


def correlations(z: DataFrame, kind: str, n: int, seed: int) -> DataFrame:
    """(kind, draw, compartment, i, j, r) of the table itself (``observed``), of ``n`` tables permuted within campaigns
    feature by feature (``null``), or of ``n`` resamples of sites (``bootstrap``), the same sites in every compartment."""
    sums = ["n", "si", "sj", "sij"]
    if kind == "observed":
        p = _products(z, ["compartment"]).withColumn("draw", F.lit(0).cast("long"))
    elif kind == "null":
        many = draws(z, n)
        place = lambda *order: F.row_number().over(over(["draw", "compartment", "campaign", "f"], *order)).alias("place")
        at = many.select("draw", "compartment", "campaign", "f", "site", place("site"))
        moved = many.select("draw", "compartment", "campaign", "f", "v", place(hash_draw(seed, "draw", "compartment", "campaign", "f", "site"), "site"))
        p = _products(at.join(moved, ["draw", "compartment", "campaign", "f", "place"]), ["draw", "compartment"])
    else:
        own = _products(z, ["compartment", "site"])
        sites = indexed(z.select("site").distinct(), "site")
        size = sites.agg(F.count(F.lit(1)).alias("__n"))
        slots = draws(sites.select(F.col("__i").alias("slot")), n).crossJoin(F.broadcast(size))
        times = slots.select("draw", (hash_draw(seed, "draw", "slot") % F.col("__n")).alias("__i")).groupBy("draw", "__i").agg(F.count(F.lit(1)).alias("__m"))
        met = times.join(sites, "__i").join(own, "site")
        p = met.groupBy("draw", "compartment", "i", "j").agg(*[F.sum(F.col("__m") * F.col(c)).alias(c) for c in sums])
    cov = p.select("draw", "compartment", "i", "j", (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")).alias("c"))
    own = cov.filter("i = j").select("draw", "compartment", F.col("i").alias("k"), F.sqrt(F.greatest("c", F.lit(0.0))).alias("s"))
    left = own.select("draw", "compartment", F.col("k").alias("i"), F.col("s").alias("a"))
    right = own.select("draw", "compartment", F.col("k").alias("j"), F.col("s").alias("b"))
    both = cov.join(left, ["draw", "compartment", "i"]).join(right, ["draw", "compartment", "j"])
    r = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce(F.col("c") / F.nullif(F.col("a") * F.col("b"), F.lit(0.0)), F.lit(0.0)))
    return both.select(F.lit(kind).alias("kind"), "draw", "compartment", "i", "j", r.alias("r"))


def neighbourhood(s: np.ndarray, k: int, alphas: Sequence[float], rounds: int = 500, tol: float = 1e-7) -> np.ndarray:
    """Coefficients of feature ``k`` on all others for each penalty, largest first, by coordinate descent on correlations."""
    b, out = np.zeros(len(s)), {}
    others = [j for j in range(len(s)) if j != k]
    for alpha in sorted(alphas, reverse=True):
        left = s[:, k] - s @ b
        for _ in range(rounds):
            moved = 0.0
            for j in others:
                old = b[j]
                g = left[j] + old
                b[j] = np.sign(g) * max(abs(g) - alpha, 0.0)
                if b[j] != old:
                    left -= s[:, j] * (b[j] - old)
                    moved = max(moved, abs(b[j] - old))
            if moved < tol:
                break
        out[alpha] = b.copy()
    return np.array([out[a] for a in alphas])


def edges(r: DataFrame, alphas: Sequence[float], most: int = 300) -> DataFrame:
    """(kind, draw, compartment, alpha, i, j, weight) of each refit: pairs that select each other; the weight is their signed geometric mean."""
    names = [x[0] for x in r.select("i").distinct().orderBy("i").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"select at most {most} features before a network")
    at = {f: k for k, f in enumerate(names)}
    alphas = [float(a) for a in alphas]
    one = r.groupBy(*KEYS).agg(F.collect_list(F.struct("i", "j", "r")).alias("pairs"))
    one = one.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1) // CHUNK))))
    parts = one.repartition(F.xxhash64(*KEYS, "chunk"))

    def fit(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                s = np.zeros((len(names), len(names)))
                for p in row.pairs:
                    s[at[p["i"]], at[p["j"]]] = s[at[p["j"]], at[p["i"]]] = p["r"]
                for k in range(row.chunk * CHUNK, min(len(names), (row.chunk + 1) * CHUNK)):
                    if s[k, k]:
                        for alpha, b in zip(alphas, neighbourhood(s, k, alphas)):
                            out += [(row.kind, row.draw, row.compartment, alpha, names[k], names[j], float(b[j])) for j in np.flatnonzero(b)]
            yield pd.DataFrame(out, columns=[*KEYS, "alpha", "from", "to", "beta"])

    kinds = f"kind string, draw long, compartment {dict(r.dtypes)['compartment']}, alpha double, `from` {dict(r.dtypes)['i']}, `to` {dict(r.dtypes)['i']}, beta double"
    b = parts.mapInPandas(fit, kinds).withColumns({"i": F.least("from", "to"), "j": F.greatest("from", "to")})
    pair = b.groupBy(*KEYS, "alpha", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.min("beta").alias("low"), F.max("beta").alias("high"))
    agree = (F.col("n") == 2) & (F.col("low") * F.col("high") > 0)
    return pair.filter(agree).select(*KEYS, "alpha", "i", "j", (F.signum("low") * F.sqrt(F.col("low") * F.col("high"))).alias("weight"))


def calibration(found: DataFrame, compartments: DataFrame, alphas: Sequence[float], n: int) -> DataFrame:
    """(alpha, compartment, observed, null): edges of the table and the mean of the permuted tables for each penalty, zeros included."""
    grid = compartments.select("compartment").distinct().withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    counts = found.groupBy(F.col("alpha").alias("a"), F.col("compartment").alias("c")).agg(F.count_if(F.col("kind") == "observed").alias("observed"), (F.count_if(F.col("kind") == "null") / F.lit(float(max(n, 1)))).alias("null"))
    met = grid.join(counts, (F.col("alpha") == F.col("a")) & (F.col("compartment") == F.col("c")), "left")
    return met.select("alpha", "compartment", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("null", F.lit(0.0)).alias("null"))


def chosen_alpha(table: DataFrame, ratio: float, least: int) -> float | None:
    """The least penalty at which every compartment has ``least`` edges and at most ``ratio`` times as many under the null; nothing if none is."""
    ok = F.min(((F.col("observed") >= least) & (F.col("null") <= ratio * F.col("observed"))).cast("int"))
    return table.groupBy("alpha").agg(ok.alias("ok")).filter("ok = 1").agg(F.min("alpha")).first()[0]


def stable_edges(observed: DataFrame, bootstrap: DataFrame, null: DataFrame, n_bootstrap: int, n_null: int, stability: float = 0.6, sign: float = 0.9, null_share: float = 0.1) -> DataFrame:
    """Edges of the table with how often resamples select them, how often with the same sign, how often permuted tables do, and whether all three pass."""
    keys = ["compartment", "i", "j"]
    b = bootstrap.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("weight").alias("w"))
    u = null.groupBy(*[F.col(k).alias(f"u_{k}") for k in keys]).agg((F.count(F.lit(1)) / F.lit(float(max(n_null, 1)))).alias("null_share"))
    same = lambda p: [F.col(k) == F.col(f"{p}_{k}") for k in keys]
    met = observed.join(b, same("b"), "left").groupBy(*keys, "weight").agg(F.count("w").alias("n"), F.count_if(F.col("w") * F.col("weight") > 0).alias("m"))
    met = met.join(u, same("u"), "left")
    out = met.select(
        *keys,
        "weight",
        (F.col("n") / F.lit(float(max(n_bootstrap, 1)))).alias("stability"),
        F.coalesce(F.col("m") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("sign_share"),
        F.coalesce("null_share", F.lit(0.0)).alias("null_share"),
    )
    passed = (F.col("stability") >= stability) & (F.col("sign_share") >= sign) & (F.col("null_share") <= null_share)
    return out.withColumn("stable", passed)


def calibrated_network(z: DataFrame, alphas: Sequence[float], n_null: int, n_bootstrap: int, seed: int, ratio: float = 0.2, least: int = 1, **settings) -> tuple[float | None, DataFrame]:
    """The chosen penalty and ``stable_edges`` at it; where no penalty passes the largest is used and none is named."""
    seen, null = edges(correlations(z, "observed", 0, seed), alphas), edges(correlations(z, "null", n_null, seed), alphas)
    alpha = chosen_alpha(calibration(seen.unionByName(null), z, alphas, n_null), ratio, least)
    used = max(alphas) if alpha is None else alpha
    boot = edges(correlations(z, "bootstrap", n_bootstrap, seed + 1), [used])
    at = lambda e: e.filter(F.abs(F.col("alpha") - used) < 1e-12)
    return alpha, stable_edges(at(seen), boot, at(null), n_bootstrap, n_null, **settings)


def summary(found: DataFrame, z: DataFrame) -> DataFrame:
    """For each compartment of the table the edges, the stable ones (by name too), their density, positive share and median strength."""
    size = z.groupBy("compartment").agg(F.countDistinct("f").alias("n"))
    name = F.when(F.col("stable"), F.concat_ws("~", "i", "j"))
    per = found.groupBy(F.col("compartment").alias("c")).agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if("stable").alias("stable"),
        F.round(F.avg((F.col("weight") > 0).cast("int")), 6).alias("positive"),
        F.round(F.median(F.abs("weight")), 6).alias("strength"),
        F.array_sort(F.collect_list(name)).alias("stable_edges"),
    )
    met = size.join(per, F.col("compartment") == F.col("c"), "left")
    edges = F.coalesce("edges", F.lit(0))
    density = F.round(2 * edges / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)), 6)
    none = F.array().cast("array<string>")
    return met.select("compartment", edges.alias("edges"), F.coalesce("stable", F.lit(0)).alias("stable"), density.alias("density"), "positive", "strength", F.coalesce("stable_edges", none).alias("stable_edges"))
