"""Null distributions, refits and resampling of named units against plain numpy versions."""

import datetime
import decimal
import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import callback, exposure, nulls, resample, windows


def draw(seed, *parts):
    return int(hashlib.md5("|".join(map(str, [seed, *parts])).encode()).hexdigest()[:8], 16)


UNITS = {
    "string": [f"site{k}" for k in range(40)],
    "date": [datetime.date(2024, 1, 1) + datetime.timedelta(days=3 * k) for k in range(40)],
    "decimal(12,2)": [decimal.Decimal(k * 37 % 401) / 4 for k in range(40)],
    "timestamp": [datetime.datetime(2024, 1, 1, 0, k) for k in range(40)],
}


@pytest.mark.parametrize("kind", sorted(UNITS))
def test_resampling_of_units_of_any_type(spark, kind):
    units = UNITS[kind]
    rng = np.random.default_rng(1)
    values = dict(zip(units, rng.normal(size=40).round(3).tolist()))
    df = spark.createDataFrame([(u, values[u]) for u in rng.permutation(np.array(units, object)).tolist()], f"unit {kind}, v double").repartition(3)
    order = sorted(units)
    mean = {d: np.mean([values[order[draw(7, d, k) % 40]] for k in range(40)]) for d in range(5)}
    got = {r.draw: r.mean for r in resample.bootstrap_means(df, "unit", "v", 5, 7).collect()}
    assert got == pytest.approx(mean)
    sums = {r.draw: r.v for r in resample.block_bootstrap(df, "unit", ["v"], 5, 7).collect()}
    assert sums == pytest.approx({d: 40 * m for d, m in mean.items()})
    named = {r.draw: r.m for r in callback.bootstrap(df, "unit", {"m": F.avg("v")}, 5, 7).collect()}
    assert named == pytest.approx(mean)
    ahead = windows.prefix_sums(df, "unit", ["v"], buckets=7).orderBy("unit").collect()
    assert [r["__i"] for r in ahead] == list(range(40))
    assert [r.v for r in ahead] == pytest.approx([sum(values[u] for u in order[:k]) for k in range(40)])


def test_interval_sums_against_all_days(spark):
    rng = np.random.default_rng(2)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=int(k))
    daily = [(s, day(k), float(rng.integers(1, 50))) for s in ("a", "b") for k in rng.choice(60, 25, replace=False)]
    daily.append(daily[0])
    visits = [(k, "abc"[k % 3], day(rng.integers(-20, 90))) for k in range(40)] + [(99, None, day(3)), (98, "a", None)]
    spans = {"w": (0, 6), "far": (10, 40), "next": (-9, -1)}
    d = spark.createDataFrame(daily, "site string, date date, mm double")
    v = spark.createDataFrame(visits, "visit int, site string, date date")
    got = {r.visit: (r.w, r.far, r.next) for r in exposure.interval_sums(v, d, ["visit"], "site", "date", "mm", spans).collect()}
    for k, s, at in visits:
        want = tuple(sum(x for t, e, x in daily if t == s and at and a <= (at - e).days <= b) for a, b in spans.values())
        assert got[k] == pytest.approx(want)
    assert exposure.interval_sums(v, d.limit(0), ["visit"], "site", "date", "mm", spans).filter("w <> 0").count() == 0


def plain_nested(units, y, draws, seed):
    """The same test with the whole design in numpy; units are (unit, stratum, factor, x)."""
    names = sorted(units)
    strata, factor, x = (np.array([units[u][k] for u in names], object) for k in range(3))
    x = x.astype(float)
    dummies = [np.ones(len(names))] + [(strata == s).astype(float) for s in sorted(set(strata))[1:]] + [(factor == f).astype(float) for f in sorted(set(factor))[1:]]
    z = np.column_stack(dummies)
    proj = z @ np.linalg.pinv(z)
    fit, res, ry = proj @ x, x - proj @ x, y - proj @ y
    free = len(names) - np.linalg.matrix_rank(np.column_stack([z, x]))

    def f(r):
        c = r - proj @ r
        effect = ((c @ ry) ** 2).sum() / (c @ c)
        return effect, effect / (((ry**2).sum() - effect) / free)

    seen = f(res)
    hits = 0
    for d in range(draws):
        moved = res.copy()
        for s in set(strata):
            at = [k for k in range(len(names)) if strata[k] == s]
            moved[at] = res[sorted(at, key=lambda k: (draw(seed, d, names[k]), names[k]))]
        hits += f(moved)[1] >= seen[1] - 1e-12
    return seen[0] / (ry**2).sum(), seen[1], (1 + hits) / (1 + draws), free


def test_nested_test_of_an_unbalanced_design(spark):
    rng = np.random.default_rng(3)
    units = {f"u{k:02d}": (f"s{rng.integers(6)}", f"p{rng.integers(3)}", float(rng.normal())) for k in range(45)}
    names = sorted(units)
    y = rng.normal(size=(45, 4)) + np.outer([units[u][2] for u in names], [0.8, 0, 0, 0.3])
    df = spark.createDataFrame([(u, *units[u]) for u in names], "unit string, stratum string, factor string, x double")
    resp = spark.createDataFrame([(u, a, float(y[k, a])) for k, u in enumerate(names) for a in range(4)], "unit string, axis int, y double")
    got = nulls.nested_test(df, resp, "unit", "stratum", ["factor"], "x", "axis", "y", 19, 5).first()
    r2, f, p, free = plain_nested(units, y, 19, 5)
    assert (got.partial_r2, got.pseudo_f, got.p, got.residual_df) == (pytest.approx(r2), pytest.approx(f), pytest.approx(p), free)
    assert got.p == 1 / 20
    alone = nulls.nested_test(df, resp, "unit", "stratum", [], "x", "axis", "y", 5, 5).first()
    assert alone.pseudo_f > 0 and alone.draws == 5
    assert nulls.nested_test(df.limit(0), resp, "unit", "stratum", ["factor"], "x", "axis", "y", 3, 5).count() == 0
    with pytest.raises(ValueError):
        nulls.nested_test(df, resp, "unit", "stratum", ["unit"], "x", "axis", "y", 3, 5, most=10)


@pytest.mark.parametrize("length", [1, 7, 500])
def test_moving_blocks_against_slices(spark, length):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 100, 50).tolist()
    df = spark.createDataFrame([(f"t{k:03d}", x, 1) for k, x in enumerate(v)], "t string, v long, n long").repartition(4)
    got = {r.draw: (r.v, r.n) for r in nulls.moving_blocks(df, "t", ["v", "n"], length, 6, 8).collect()}
    size = min(length, 50)
    for d in range(6):
        starts = [draw(8, d, k) % (50 - size + 1) for k in range(-(-50 // size))]
        assert got[d] == (sum(sum(v[s : s + size]) for s in starts), size * len(starts))
    assert nulls.moving_blocks(df.limit(0), "t", ["v"], 3, 2, 8).count() == 0


def test_refits_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(8):
        for t in range(12):
            x = rng.normal(size=2)
            rows.append((f"g{g}", float(t), float(x[0]), float(x[1]), float(0.5 * t + 2 * x[1] + rng.normal())))
    df = spark.createDataFrame([*rows, ("g0", 1.0, None, 2.0, 3.0)], "g string, t double, a double, b double, y double").withColumn("flat", F.lit(1.0))
    refits = nulls.refit_bootstrap(df, "g", "y", ["a", "b", "flat"], ["t"], 6, 9).collect()
    selected = {r.draw: r for r in nulls.selected_refits(nulls.refit_bootstrap(df, "g", "y", ["a", "b", "flat"], ["t"], 6, 9)).collect()}
    for d in range(-1, 6):
        picked = [f"g{draw(9, d, k) % 8}" for k in range(8)] if d >= 0 else [f"g{k}" for k in range(8)]
        some = np.array([r[1:] for p in picked for r in rows if r[0] == p])
        z = np.column_stack([np.ones(len(some)), some[:, 0]])
        clean = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        y = clean(some[:, 3])
        for j, c in ((1, "a"), (2, "b")):
            x = clean(some[:, j])
            r = next(r for r in refits if r.draw == d and r.candidate == c)
            assert (r.beta, r.rho) == (pytest.approx(x @ y / (x @ x)), pytest.approx(x @ y / math.sqrt((x @ x) * (y @ y))))
        assert next(r for r in refits if r.draw == d and r.candidate == "flat").beta is None
        assert selected[d].selected == "b" and selected[d].fixed_beta == selected[d].selected_beta


def test_weighted_refits_are_paired_and_mark_lost_rank(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 4, float(rng.normal()), float(k % 4 == 3), float(rng.uniform(1, 2)), float(rng.normal()), float(rng.normal())) for k in range(60)]
    df = spark.createDataFrame(rows, "block long, x double, target double, w double, p double, q double")
    got = nulls.weighted_refits(df, "block", ["p", "q"], ["x", "target"], "w", 12, 3).collect()
    data = np.array([r[1:] for r in rows])
    for d in range(-1, 12):
        picked = [draw(3, d, k) % 4 for k in range(4)] if d >= 0 else range(4)
        some = np.array([row for b in picked for row, r in zip(data, rows) if r[0] == b])
        a = np.column_stack([np.ones(len(some)), some[:, :2]])
        mine = [r for r in got if r.draw == d]
        rank = np.linalg.matrix_rank(a)
        assert [r.valid for r in mine] == [rank == 3] * 2
        for r in mine:
            if r.valid:
                root = np.sqrt(some[:, 2])
                beta = np.linalg.lstsq(a * root[:, None], some[:, 3 if r.response == "p" else 4] * root, rcond=None)[0]
                assert [r.beta_0, r.beta_1, r.beta_2] == pytest.approx(beta.tolist())
    assert any(not r.valid for r in got)


def test_permutations_are_unranked_in_order(spark):
    for n in (1, 2, 5):
        got = spark.range(math.factorial(n)).select("id", nulls.unranked(F.col("id"), n).alias("p")).orderBy("id").collect()
        assert [tuple(r.p) for r in got] == list(itertools.permutations(range(n)))


def test_orbit_p_is_exact(spark):
    rng = np.random.default_rng(7)
    m = rng.integers(0, 5, (4, 4)).astype(float)
    df = spark.createDataFrame([(f"y{i}", f"y{j}", float(m[i, j])) for i in range(4) for j in range(4)], "i string, j string, value double")
    got = {r.mapping: (r.stat, r.p) for r in nulls.permutation_orbit(df).collect()}
    stats = {",".join(map(str, p)): sum(m[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(4))}
    assert got == {k: (v, pytest.approx(np.mean([w >= v for w in stats.values()]))) for k, v in stats.items()}
    assert nulls.permutation_orbit(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nulls.permutation_orbit(df, most=3)


def test_scrambled_numbers_are_a_bijection(spark):
    got = [r.t for r in spark.range(4**5).select(nulls.scrambled(F.col("id"), 5, 3).alias("t")).collect()]
    assert sorted(got) == list(range(4**5)) and got != sorted(got)


@pytest.mark.parametrize("radices, n", [([5, 7, 3], 104), ([5, 7, 3], 20), ([1000] * 6, 50), ([1], 3)])
def test_tuples_come_once(spark, radices, n):
    got = nulls.distinct_tuples(spark, radices, n, 2).orderBy("draw").collect()
    tuples = [tuple(r.digits) for r in got]
    assert len(set(tuples)) == len(tuples) == min(n, math.prod(radices) - 1)
    assert all(0 <= x < r for t in tuples for x, r in zip(t, radices)) and tuple([0] * len(radices)) not in tuples
    assert [r.draw for r in got] == list(range(len(got)))


def test_shift_null_adds_pieces_and_tells_rank(spark):
    rng = np.random.default_rng(8)
    rows, table = [], {}
    for g in "ab":
        for s in range(3):
            x, y = rng.normal(size=(20, 2)), rng.normal(size=20)
            if s == 2:
                x[:, 1] = 2 * x[:, 0]
            table[g, s] = (x, y)
            rows.append((g, s, float(y @ y), *[float(v) for v in (x[:, 0] @ y, x[:, 1] @ y, x[:, 0] @ x[:, 0], x[:, 0] @ x[:, 1], x[:, 1] @ x[:, 1])]))
    pieces = spark.createDataFrame(rows, "group string, shift long, yy double, xy_0 double, xy_1 double, xx_0_0 double, xx_0_1 double, xx_1_1 double")
    tuples = spark.createDataFrame([(0, [0, 1]), (1, [2, 2]), (2, [9, 0])], "draw long, digits array<long>")
    got = {r.draw: r for r in nulls.shift_null(pieces, tuples, ["a", "b"], 2).collect()}
    x, y = (np.concatenate([table["a", 0][k], table["b", 1][k]]) for k in (0, 1))
    want = [x[:, j] @ y / math.sqrt((x[:, j] @ x[:, j]) * (y @ y)) for j in range(2)]
    assert [got[0].r_0, got[0].r_1] == pytest.approx(want) and got[0].top == pytest.approx(max(map(abs, want)))
    assert (got[0].rank, got[1].rank) == (2, 1) and 2 not in got


def test_redundancy_null_against_plain_profiles(spark):
    rng = np.random.default_rng(9)
    counts = {(s, f"f{k}"): int(rng.integers(0, 9)) for s in "abcd" for k in range(6)}
    traits = {f"f{k}": [f"t{j}" for j in range(4) if rng.random() < 0.5] for k in range(6)}
    df = spark.createDataFrame([(s, f, v) for (s, f), v in counts.items() if v], "s string, f string, v long")
    ann = spark.createDataFrame([(f, t) for f, ts in traits.items() for t in ts], "f string, t string")
    got = {r.draw: r.median for r in nulls.redundancy_null(df, ann, "s", "f", "t", "v", 4, 6).collect()}
    features = sorted({f for (_, f), v in counts.items() if v})
    for d in range(-1, 4):
        label = dict(zip(features, sorted(features, key=lambda f: (draw(6, d, f), f)) if d >= 0 else features))
        profile = {s: Counter() for s in "abcd"}
        for (s, f), v in counts.items():
            for t in traits[label[f]] if v else ():
                profile[s][t] += v
        held = [s for s in "abcd" if profile[s]]
        bray = [1 - 2 * sum(min(profile[i][t], profile[j][t]) for t in profile[i]) / (sum(profile[i].values()) + sum(profile[j].values())) for i, j in itertools.combinations(held, 2)]
        assert got[d] == pytest.approx(np.median(bray))


def test_held_out_skill_finds_a_planted_trend(spark):
    """A trend along the axis is foretold where the other blocks and campaigns show it, and a shuffled axis is not."""
    rng = np.random.default_rng(10)
    rows = []
    for c in range(3):
        for u in range(16):
            for f in range(6):
                mean = math.exp(3 + (f - 2.5) * (u - 8) / 8)
                rows.append((u // 4, c, "deep", u, f"f{f}", int(rng.poisson(mean)), float(u), float((u * 7) % 16)))
    df = spark.createDataFrame(rows, "b long, c long, s string, u long, f string, v long, x double, w double")
    with_trend, without = (
        nulls.pooled_skill(nulls.held_out_skill(df, "b", "c", "s", "u", "f", "v", x, 6, 0.1)).first() for x in ("x", "w")
    )
    assert with_trend.folds == 12 and with_trend.pooled > 0.4 and with_trend.equal_weight > 0.3
    assert without.pooled < with_trend.pooled - 0.3
    assert nulls.held_out_skill(df.limit(0), "b", "c", "s", "u", "f", "v", "x", 6, 0.1).count() == 0
    with pytest.raises(ValueError):
        nulls.held_out_skill(df, "b", "c", "s", "u", "f", "v", "x", 6, 0.1, most=5)
