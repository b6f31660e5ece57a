"""Models whose algebra is small: grouped sums on the cluster, a few columns square on the driver.

Kernels over one configuration each (graphical lasso, covariance sensitivity)
run as one task per configuration through ``applyInPandas`` over a matrix of checked size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.mathfn import clopper_pearson, t_tail
from varve.operators.compose import densify
from varve.operators.resample import hash_draw
from varve.operators.stats import _matrix, gram, ols
from varve.operators.windows import global_average_rank, over
from varve.session import durable


def partial_spearman(df: DataFrame, x: str, y: str, covariates: Sequence[str]) -> dict:
    """Correlation of the ranks of x and y after regression on the ranks of the covariates, with its t test."""
    cols = [x, y, *covariates]
    ranks = df.select(*cols).dropna()
    for i, c in enumerate(cols):
        ranks = global_average_rank(ranks, c, f"__r{i}")
    ranks = ranks.select(F.lit(1.0).alias("__one"), *[F.col(f"__r{i}").alias(c) for i, c in enumerate(cols)])
    order = ["__one", *covariates, x, y]
    row = gram(ranks, order).first()
    m, k, n = _matrix(row, len(order)), len(covariates) + 1, row["n"]
    z, b = m[:k, :k], m[:k, k:]
    s = m[k:, k:] - b.T @ np.linalg.pinv(z) @ b
    r = float(s[0, 1] / math.sqrt(s[0, 0] * s[1, 1])) if s[0, 0] > 0 and s[1, 1] > 0 else float("nan")
    free = n - int(np.linalg.matrix_rank(z)) - 1
    t = r * math.sqrt(free / (1 - r * r)) if abs(r) < 1 and free > 0 else float("nan")
    return {"r": r, "t": t, "df": free, "p": t_tail(t, free) if t == t else float("nan"), "n": n}


def joint_regression(df: DataFrame, y: str, xs: Sequence[str]) -> dict:
    """Several regressors at once: coefficients, t values and the joint F; invalid where their rank is short."""
    fit = ols(df, y, xs)
    null = ols(df.dropna(subset=[y, *xs]), y, [])
    free = fit["n"] - fit["rank"]
    full = fit["rank"] == len(xs) + 1
    f = ((null["rss"] - fit["rss"]) / len(xs)) / (fit["rss"] / free) if full and free > 0 else float("nan")
    return fit | {"t": fit["beta"] / np.where(fit["se"] > 0, fit["se"], np.nan), "f": f, "valid": full}


def binomial_glm(df: DataFrame, positives: str, total: str, xs: Sequence[str], cluster: str, rounds: int = 50, tol: float = 1e-8, ridge: float = 1e-10) -> dict:
    """Logistic regression of counts by reweighted least squares with a cluster sandwich.

    Every round is one grouped sum over the data; the driver holds k x k numbers.
    """
    cols = ["__one", *xs]
    data = df.select(cluster, positives, total, *xs).withColumn("__one", F.lit(1.0))
    beta = np.zeros(len(cols))
    step = rounds
    for step in range(rounds):
        eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, cols)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        d = data.withColumns({"__w": F.col(total) * mu * (1 - mu), "__e": F.col(positives) - F.col(total) * mu})
        sums = [F.sum(F.col("__w") * F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
        row = d.agg(*sums, *[F.sum(F.col("__e") * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        info = _matrix(row, len(cols)) + ridge * np.eye(len(cols))
        move = np.linalg.solve(info, np.array([row[f"s{i}"] for i in range(len(cols))]))
        beta = beta + move
        if np.abs(move).max() < tol:
            break
    per = d.groupBy(cluster).agg(*[F.sum(F.col("__e") * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    meat = gram(per, [f"s{i}" for i in range(len(cols))]).first()
    g, inverse = meat["n"], np.linalg.inv(info)
    cov = inverse @ _matrix(meat, len(cols)) @ inverse * g / max(g - 1, 1)
    return {"beta": beta, "se": np.sqrt(np.diag(cov)), "rounds": step + 1, "clusters": g}


def gee_exchangeable(df: DataFrame, y: str, xs: Sequence[str], cluster: str, rounds: int = 20, tol: float = 1e-9) -> dict:
    """Gaussian estimating equations with exchangeable correlation inside clusters and robust covariance.

    The inverse of an exchangeable matrix needs only each cluster's size and
    sums, so a round is one pass of grouped sums.
    """
    cols = ["__one", *xs]
    data = df.select(cluster, y, *xs).dropna().withColumn("__one", F.lit(1.0))
    k, rho = len(cols), 0.0
    own = gram(data, [*cols, y], [cluster]).toDF(cluster, "n", *[f"g_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)])
    sums = data.groupBy(cluster).agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate([*cols, y])])
    per = durable(own.join(sums, cluster))
    n_all, g = per.agg(F.sum("n"), F.count(F.lit(1))).first()
    beta = np.zeros(k)
    for _ in range(rounds):
        shrink = F.lit(rho) / (1 + (F.col("n") - 1) * rho)
        terms = [(F.sum((F.col(f"g_{i}_{j}") - shrink * F.col(f"s{i}") * F.col(f"s{j}")) / (1 - rho))).alias(f"g_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
        m = _matrix(per.agg(*terms).first(), k + 1)
        new = np.linalg.solve(m[:k, :k], m[:k, k])
        v = np.append(-new, 1.0)
        rss = sum((F.lit(float(v[i] * v[j] * (1 if i == j else 2))) * F.col(f"g_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)), F.lit(0.0))
        tot = sum((F.lit(float(v[i])) * F.col(f"s{i}") for i in range(k + 1)), F.lit(0.0))
        ss, cross, pairs = per.agg(F.sum(rss), F.sum((tot * tot - rss) / 2), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
        phi = ss / (n_all - k)
        rho = float(np.clip(cross / max(pairs - k, 1) / phi, -0.99, 0.99)) if pairs else 0.0
        done = np.abs(new - beta).max() < tol
        beta = new
        if done:
            break
    v = np.append(-beta, 1.0)
    shrink = F.lit(rho) / (1 + (F.col("n") - 1) * rho)
    name = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    score = [sum((F.lit(float(v[j])) * (F.col(name(i, j)) - shrink * F.col(f"s{i}") * F.col(f"s{j}")) for j in range(k + 1)), F.lit(0.0)) / (1 - rho) for i in range(k)]
    meat = _matrix(gram(per.select(*[s.alias(f"u{i}") for i, s in enumerate(score)]), [f"u{i}" for i in range(k)]).first(), k)
    bread = np.linalg.inv(m[:k, :k])
    cov = bread @ meat @ bread
    return {"beta": beta, "se": np.sqrt(np.diag(cov)), "cov": cov, "rho": rho, "clusters": g}


def wald(fit: dict, which: Sequence[int]) -> float:
    """Joint Wald statistic of some coefficients."""
    b, c = fit["beta"][list(which)], fit["cov"][np.ix_(list(which), list(which))]
    return float(b @ np.linalg.pinv(c) @ b)


def trend_r2(df: DataFrame, position: str, feature: str, value: str) -> DataFrame:
    """R2 and pseudo-F over all features of a quadratic in the standardised position.

    ``df`` has one row for each (unit, feature); two regressors are solved in
    closed form from one grouped sum for each feature.
    """
    stats = df.agg(F.avg(position).alias("__m"), F.stddev_pop(position).alias("__s"), F.countDistinct(position).alias("__n"))
    d = df.crossJoin(F.broadcast(stats)).withColumn("x", (F.col(position) - F.col("__m")) / (F.col("__s") * F.sqrt(F.col("__n") / (F.col("__n") - 1))))
    d = d.withColumn("q", F.col("x") * F.col("x"))
    c = d.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("x", "x").alias("xx"),
        F.covar_pop("q", "q").alias("qq"),
        F.covar_pop("x", "q").alias("xq"),
        F.covar_pop("x", value).alias("xy"),
        F.covar_pop("q", value).alias("qy"),
        F.var_pop(value).alias("yy"),
    )
    det = F.col("xx") * F.col("qq") - F.col("xq") * F.col("xq")
    explained = (F.col("qq") * F.col("xy") * F.col("xy") - 2 * F.col("xq") * F.col("xy") * F.col("qy") + F.col("xx") * F.col("qy") * F.col("qy")) / det
    out = c.agg(F.max("n").alias("n"), F.sum(explained * F.col("n")).alias("ssr"), F.sum(F.col("yy") * F.col("n")).alias("tss"))
    r2 = F.col("ssr") / F.col("tss")
    return out.select("n", r2.alias("r2"), (F.col("ssr") / 2 / ((F.col("tss") - F.col("ssr")) / (F.col("n") - 3))).alias("pseudo_f"))


def principal_axes(df: DataFrame, unit: str, axis: str, value: str, k: int = 2) -> DataFrame:
    """Scores of the leading principal components of a long table, each loading vector's largest entry positive.

    The p x p scatter of the centred axes is one join and sum; p is the number
    of selected features and is checked, since the driver factorises it.
    """
    axes = [r[0] for r in df.select(axis).distinct().orderBy(axis).limit(2001).collect()]
    if len(axes) > 2000:
        raise ValueError("select at most 2000 features before an ordination")
    centred = df.withColumn("__z", F.col(value) - F.avg(value).over(over([axis])))
    a = centred.select(F.col(unit).alias("u"), F.col(axis).alias("a"), F.col("__z").alias("za"))
    b = centred.select(F.col(unit).alias("w"), F.col(axis).alias("b"), F.col("__z").alias("zb"))
    rows = a.join(b, (F.col("u") == F.col("w")) & (F.col("a") <= F.col("b"))).groupBy("a", "b").agg(F.sum(F.col("za") * F.col("zb")).alias("s")).collect()
    at = {x: i for i, x in enumerate(axes)}
    m = np.zeros((len(axes), len(axes)))
    for x, y, s in rows:
        m[at[x], at[y]] = m[at[y], at[x]] = s
    values, vectors = np.linalg.eigh(m)
    vectors = vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    load = df.sparkSession.createDataFrame([(x, *map(float, vectors[at[x]])) for x in axes], ", ".join([f"`{axis}` {dict(df.dtypes)[axis]}", *[f"l{i + 1} double" for i in range(vectors.shape[1])]]))
    scores = centred.join(F.broadcast(load), axis).groupBy(unit).agg(*[F.sum(F.col("__z") * F.col(f"l{i + 1}")).alias(f"pc{i + 1}") for i in range(vectors.shape[1])])
    share = values[::-1][:k] / values.sum()
    return scores.withColumns({f"share{i + 1}": F.lit(float(s)) for i, s in enumerate(share)})


def principal_coordinates(distances: DataFrame, fraction: float = 0.9, most: int = 3000) -> DataFrame:
    """(unit, axis, value, retained) of a pair table (i, j, distance): positive axes until they hold ``fraction``.

    Squared distances are centred by grouped means; the driver factorises one
    units x units matrix, so the number of units is checked before any pair moves.
    """
    pairs = distances.select("i", "j", "distance")
    both = pairs.union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")).withColumn("q", F.col("distance") * F.col("distance"))
    n = both.select("i").distinct().count()
    if n > most:
        raise ValueError(f"at most {most} units")
    rows = both.groupBy("i").agg((F.sum("q") / n).alias("m"))
    whole = rows.agg(F.avg("m").alias("whole"))
    other = rows.select(F.col("i").alias("j"), F.col("m").alias("mj"))
    zero = rows.select("i", F.col("i").alias("j"), F.lit(0.0).alias("q"))
    centred = both.select("i", "j", "q").union(zero).join(rows, "i").join(other, "j").crossJoin(F.broadcast(whole))
    table = centred.select("i", "j", (-0.5 * (F.col("q") - F.col("m") - F.col("mj") + F.col("whole"))).alias("b")).toPandas()
    ids = sorted(set(table.i))
    at = {x: k for k, x in enumerate(ids)}
    b = np.zeros((n, n))
    b[table.i.map(at), table.j.map(at)] = table.b
    values, vectors = np.linalg.eigh(b)
    values, vectors = values[::-1], vectors[:, ::-1]
    positive = values > max(values[0], 0) * 1e-10 if n else values > 0
    values, vectors = values[positive], vectors[:, positive]
    keep = min(len(values), int(np.searchsorted(np.cumsum(values) / values.sum(), fraction - 1e-12)) + 1) if len(values) else 0
    load = vectors[:, :keep] * np.sqrt(values[:keep])
    load = load * np.where(load[np.abs(load).argmax(axis=0), range(keep)] < 0, -1, 1) if keep else load
    retained = float(values[:keep].sum() / values.sum()) if keep else 0.0
    kind = dict(distances.dtypes)["i"]
    out = [(x, k + 1, float(load[at[x], k]), retained) for x in ids for k in range(keep)]
    return distances.sparkSession.createDataFrame(out, f"unit {kind}, axis int, value double, retained double")


def variance_partition(df: DataFrame, y: str, first: Sequence[str], second: Sequence[str], nuisance: Sequence[str]) -> dict:
    """Unique, shared and unexplained fractions of two sets of regressors after nuisance ones; shared may be negative."""
    sse = {
        "n": ols(df, y, nuisance)["rss"],
        "p": ols(df, y, [*nuisance, *first])["rss"],
        "g": ols(df, y, [*nuisance, *second])["rss"],
        "pg": ols(df, y, [*nuisance, *first, *second])["rss"],
    }
    n = sse["n"]
    return {"unique_first": (sse["g"] - sse["pg"]) / n, "unique_second": (sse["p"] - sse["pg"]) / n, "shared": (n - sse["p"] - sse["g"] + sse["pg"]) / n, "unexplained": sse["pg"] / n}


def tost(estimate: float, se: float, margin: float, justified: bool) -> dict:
    """Equivalence by two one-sided normal tests; no claim without a justified margin."""
    if not justified or not se > 0:
        return {"p": None, "verdict": "no_claim"}
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    p = max(tail((estimate + margin) / se), tail((margin - estimate) / se))
    return {"p": p, "verdict": "equivalent" if p < 0.05 else "not_shown"}


def rope_mass(estimate: float, se: float, margin: float) -> float:
    """Normal probability inside the margin."""
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    return cdf((margin - estimate) / se) - cdf((-margin - estimate) / se)


def graphical_lasso(s: np.ndarray, alpha: float, rounds: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Sparse inverse of a covariance by block coordinate descent (Friedman et al. 2008)."""
    p = len(s)
    w = s.copy()
    beta = np.zeros((p, p))
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            v, target, b = w[np.ix_(rest, rest)], s[rest, j], beta[rest, j]
            for _ in range(100):
                last = b.copy()
                for k in range(p - 1):
                    r = target[k] - v[k] @ b + v[k, k] * b[k]
                    b[k] = np.sign(r) * max(abs(r) - alpha, 0) / v[k, k]
                if np.abs(b - last).max() < tol:
                    break
            beta[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - before).max() < tol:
            break
    theta = np.zeros((p, p))
    for j in range(p):
        rest = np.arange(p) != j
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ beta[rest, j])
        theta[rest, j] = -beta[rest, j] * theta[j, j]
    return (theta + theta.T) / 2


def network_edges(df: DataFrame, unit: str, feature: str, value: str, alphas: Sequence[float], draws: int = 0, seed: int = 1, edge: float = 1e-3) -> DataFrame:
    """Partial-correlation edges for each penalty and draw; draw 0 is the data, others permute each feature over the units.

    Permuting and the products of features are joins and grouped sums over the
    table; a (penalty, draw) task gets the correlations of the selected features only.
    """
    rows = df.select(F.col(unit).cast("string").alias("u"), F.col(feature).cast("string").alias("f"), F.col(value).cast("double").alias("v"))
    rows = densify(rows.groupBy("u", "f").agg(F.avg("v").alias("v")), ["u"], "f", "v", rows)
    sd = F.stddev_pop("v").over(over(["f"]))
    z = rows.select("u", "f", ((F.col("v") - F.avg("v").over(over(["f"]))) / F.when(sd > 0, sd).otherwise(1.0)).alias("z"))
    many = z.crossJoin(F.broadcast(df.sparkSession.range(draws + 1).select(F.col("id").alias("draw"))))
    drawn = F.when(F.col("draw") > 0, hash_draw(seed, "draw", "f", "u")).otherwise(0)
    place = lambda *order: F.row_number().over(over(["draw", "f"], *order)).alias("place")
    moved = many.select("draw", "f", "u", place("u")).join(many.select("draw", "f", "z", place(drawn, "u")), ["draw", "f", "place"])
    a = moved.select("draw", "u", F.col("f").alias("i"), F.col("z").alias("zi"))
    b = moved.select("draw", "u", F.col("f").alias("j"), F.col("z").alias("zj"))
    products = a.join(b, ["draw", "u"]).filter("i <= j").groupBy("draw", "i", "j").agg(F.avg(F.col("zi") * F.col("zj")).alias("s"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        draw, alpha = key
        names = sorted(set(pdf.i))
        at = {f: k for k, f in enumerate(names)}
        s = np.zeros((len(names), len(names)))
        s[pdf.i.map(at), pdf.j.map(at)] = s[pdf.j.map(at), pdf.i.map(at)] = pdf.s
        theta = graphical_lasso(s, alpha)
        d = np.sqrt(np.diag(theta))
        partial = -theta / np.outer(d, d)
        i, j = np.nonzero(np.triu(np.abs(partial) > edge, 1))
        label = np.array(names, dtype=object)
        return pd.DataFrame(
            {"draw": np.full(len(i), int(draw)), "alpha": np.full(len(i), float(alpha)), "i": label[i].astype(object), "j": label[j].astype(object), "partial": partial[i, j]}
        )

    return products.crossJoin(F.broadcast(grid)).groupBy("draw", "alpha").applyInPandas(fit, "draw long, alpha double, i string, j string, partial double")


def calibrated_alpha(edges: DataFrame, alphas: Sequence[float], draws: int, ratio: float = 0.1, least: int = 10) -> float:
    """The least penalty whose null edges are at most ``ratio`` of the observed ones; the largest if none is."""
    n = edges.groupBy("alpha").agg(F.count_if(F.col("draw") == 0).alias("seen"), F.count_if(F.col("draw") > 0).alias("null")).collect()
    ok = [r.alpha for r in n if r.seen >= least and r.null / max(draws, 1) <= ratio * r.seen]
    return min(ok) if ok else max(alphas)


def covariance_sensitivity(points: DataFrame, unit: str, x: str, y: str, predictor: str, response: str, models: DataFrame, rotations: int = 199, seed: int = 1, most: int = 4000) -> DataFrame:
    """For each model (kind, length, noise): r2 after whitening by its covariance, and a rotation p value with an exact interval.

    A model's task holds one points x points matrix, so the number of points is checked first.
    """
    if points.count() > most:
        raise ValueError(f"at most {most} points")
    data = points.select(F.col(unit).cast("string").alias("u"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (predictor, "p"), (response, "r"))])
    each = data.crossJoin(F.broadcast(models))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, length, noise = key
        pdf = pdf.sort_values("u")
        d = np.hypot(*(pdf[c].to_numpy()[:, None] - pdf[c].to_numpy() for c in ("x", "y"))) / length
        s = {"exponential": np.exp(-d), "matern32": (1 + 3**0.5 * d) * np.exp(-(3**0.5) * d), "matern52": (1 + 5**0.5 * d + 5 * d * d / 3) * np.exp(-(5**0.5) * d)}[kind]
        low = np.linalg.cholesky((1 - noise) * s + noise * np.eye(len(s)))
        one, p, r = (np.linalg.solve(low, v) for v in (np.ones(len(s)), pdf["p"].to_numpy(), pdf["r"].to_numpy()))
        q = one / np.linalg.norm(one)
        p, r = p - q * (q @ p), r - q * (q @ r)
        observed = (p @ r) ** 2 / ((p @ p) * (r @ r))
        rng = np.random.default_rng(seed)
        g = rng.standard_normal((rotations, len(s)))
        g -= np.outer(g @ q, q)
        null = (g @ p) ** 2 / ((g * g).sum(axis=1) * (p @ p))
        k = int((null >= observed - 1e-12).sum())
        lo, hi = clopper_pearson(k, rotations)
        return pd.DataFrame({"kind": [kind], "length": [length], "noise": [noise], "r2": [observed], "p": [(1 + k) / (1 + rotations)], "p_low": [lo], "p_high": [hi]})

    return each.groupBy("kind", "length", "noise").applyInPandas(run, "kind string, length double, noise double, r2 double, p double, p_low double, p_high double")
