"""Hand-calculated values, algebraic identities and brute-force equivalences."""

import datetime
import gzip
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions import ids, mathfn
from varve.operators import callback, compose, exposure, linear, relational, resample, spatial, stats, windows
from varve.operators.contracts import ContractError, padded_or_null, require
from varve.sources import io
from varve.streaming import exposure as streaming


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")
    got = {r.id: r.q for r in windows.benjamini_hochberg(df, "p").collect()}
    assert got[4] is None and [round(got[i], 9) for i in (1, 2, 3)] == [0.03, 0.04, 0.04]


def test_hurlbert_known_case(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1)], "s string, f string, c long")
    got = {r.s: r.expected_richness for r in compose.expected_richness(df, ["s"], "c", 2).collect()}
    assert got["a"] == pytest.approx(1 + 2 / 3, abs=1e-9) and got["b"] is None


def test_log_gamma_and_tails(spark):
    xs = [0.5, 1.0, 3.0, 10.5, 1e4]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(mathfn.log_gamma(F.col("x")).alias("g"), mathfn.normal_tail("x").alias("t")).collect()
    assert [r.g for r in got] == pytest.approx([math.lgamma(x) for x in xs], abs=1e-8)
    assert got[1].t == pytest.approx(0.15865525393145707)
    assert mathfn.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert mathfn.t_tail(2.262157163, 9) == pytest.approx(0.05, abs=1e-8)
    assert mathfn.clopper_pearson(0, 10) == (0.0, pytest.approx(0.3084971, abs=1e-6))
    assert mathfn.clopper_pearson(5, 10) == (pytest.approx(0.1870860, abs=1e-6), pytest.approx(0.8129140, abs=1e-6))


@pytest.mark.parametrize("orbit, shift, p", [([9, 8, 7, 6, 5, 4], 0, 1 / 6), ([9, 9, 7, 6, 5, 4], 0, 2 / 6), ([9, 8, 7, 6, 5, 4], 5, 1.0)])
def test_exact_orbit(orbit, shift, p):
    assert np.mean([v >= orbit[shift] - 1e-12 for v in orbit]) == pytest.approx(p)


def test_season_remap(spark):
    df = spark.createDataFrame([(datetime.date(2023, 12, 20),), (datetime.date(2022, 3, 1),)], "d date")
    got = [r.m for r in df.select(ids.remapped_date(F.col("d"), {2023: 2025, 2024: 2023}).alias("m")).collect()]
    assert got == [datetime.date(2022, 12, 20), None]
    leap = spark.createDataFrame([(datetime.date(2024, 2, 29),)], "d date")
    with pytest.raises(Exception):
        leap.select(ids.remapped_date(F.col("d"), {2024: 2023})).collect()


def test_sample_ids(spark):
    rows = ["e0325_10Dr2", "F61PRr3", "V17PRr1", "not-a-sample", "T 5 S r1"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in rows], "id string").select(ids.sample_id(F.col("id")).alias("p")).collect()]
    assert [tuple(g) if g else None for g in got] == [(1, 10, "Deep", 2), (3, 61, "Rhizosphere", 3), (5, 17, "Rhizosphere", 1), None, (2, 5, "Surface", 1)]


def test_clr_rows_sum_to_zero(spark):
    df = spark.createDataFrame([(s, f, (s * f) % 5) for s in range(4) for f in range(6)], "s int, f int, c int")
    for made in (compose.clr(df, ["s"], "c"), compose.clr_replaced(df.filter("s > 0"), ["s"], "c"), compose.clr_adaptive(df, ["s"], "c")):
        assert all(abs(r.t) < 1e-9 for r in made.groupBy("s").agg(F.sum("clr").alias("t")).collect())


def test_dissimilarity_identities(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(0, 6, (6, 9))
    m[5] = 0
    m[5, 8] = 3
    df = spark.createDataFrame([(i, j, int(m[i, j])) for i in range(6) for j in range(9) if m[i, j]], "s int, f int, c int")
    for r in compose.bray_curtis(df, "s", "f", "c").collect():
        expected = np.abs(m[r.i] - m[r.j]).sum() / (m[r.i] + m[r.j]).sum()
        assert r.bray == pytest.approx(expected) and r.balanced + r.gradient == pytest.approx(r.bray)
    for r in compose.sorensen(df, "s", "f").collect():
        a, b = m[r.i] > 0, m[r.j] > 0
        assert r.sorensen == pytest.approx((a ^ b).sum() / (a.sum() + b.sum())) and r.turnover + r.nestedness == pytest.approx(r.sorensen)


def test_turnover_decomposition_is_an_identity(spark):
    rows = [("a", 1.0, 0.2, 0.1), ("a", 3.0, 0.1, 0.3), ("b", 2.0, 0.4, 0.0), ("c", 5.0, 0.0, 0.6), ("d", 4.0, 0.3, 0.0)]
    r = compose.trait_turnover(spark.createDataFrame(rows, "g string, t double, x double, y double"), "g", "t", "x", "y").first()
    assert r.between + r.within + r.exclusive == pytest.approx(r.total)
    assert r.total == pytest.approx(sum(t * (x - y) for _, t, x, y in rows))


def test_rarefaction_keeps_depth_and_repeats(spark):
    df = spark.createDataFrame([("s", f"f{i}", i + 1) for i in range(8)], "s string, f string, c long")
    a = compose.rarefied_counts(df, ["s"], "f", "c", 20, 4, 1)
    assert {r.t for r in a.groupBy("draw").agg(F.sum("c").alias("t")).collect()} == {20}
    again = compose.rarefied_counts(df.repartition(3), ["s"], "f", "c", 20, 4, 1)
    assert sorted(map(str, a.collect())) == sorted(map(str, again.collect()))


def test_rarefaction_of_zeros_large_counts_and_short_samples(spark):
    big = 3_000_000_000
    rows = [("a", "x", big), ("a", "y", big), ("a", "none", 0), ("a", "null", None), ("b", "x", 5), ("b", "none", 0)]
    got = compose.rarefied_counts(spark.createDataFrame(rows, "s string, f string, c long"), ["s"], "f", "c", 400, 60, 3).collect()
    assert {r.f for r in got} == {"x", "y"}
    assert all(r.c == 5 for r in got if r.s == "b")  # a sample of fewer reads than the depth is taken whole
    x = [r.c for r in got if r.s == "a" and r.f == "x"]
    totals = {}
    for r in got:
        totals[r.s, r.draw] = totals.get((r.s, r.draw), 0) + r.c
    assert {v for (s, _), v in totals.items() if s == "a"} == {400} and len(x) == 60
    # binomial with mean 200 and standard deviation 10
    assert abs(np.mean(x) - 200) < 6 and 7 < np.std(x) < 13.5


def test_rarefaction_is_hypergeometric(spark):
    got = compose.rarefied_counts(spark.createDataFrame([("a", "x", 30), ("a", "y", 20)], "s string, f string, c long"), ["s"], "f", "c", 10, 600, 5).collect()
    x = [r.c for r in got if r.f == "x"]
    assert abs(np.mean(x) - 6) < 0.2 and abs(np.var(x) - 10 * 0.6 * 0.4 * 40 / 49) < 0.35


def test_exact_quantiles_and_places(spark):
    rng = np.random.default_rng(11)
    v = [float(x) for x in np.round(rng.normal(size=700), 1)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").repartition(5)
    f = [0.0, 0.05, 0.5, 0.77, 1.0]
    assert windows.global_quantiles(df, "v", f) == pytest.approx(list(np.quantile(v, f)))
    assert windows.global_quantiles(df.limit(0), "v", f) == []
    units = spark.createDataFrame([(3 * i,) for i in range(500)], "u long").repartition(4)
    assert {r.u: r.at for r in windows.indexed(units, "u", "at").collect()} == {3 * i: i for i in range(500)}


def test_nearest_by_cells_is_exact(spark):
    rng = np.random.default_rng(12)
    pts = [(g, i, float(x), float(y)) for g in "ab" for i, (x, y) in enumerate(rng.normal(size=(60, 2)) ** 3)] + [("a", 100, 0.0, 0.0), ("a", 101, 0.0, 0.0), ("c", 1, 0.0, 0.0), ("c", 2, 9.0, 9.0)]
    got = relational.nearest(spark.createDataFrame(pts, "g string, k long, x double, y double"), "k", "x", "y", 4, ["g"]).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.g, r.i), set()).add(r.j)
    for g, k, x, y in pts:
        others = sorted((round(math.hypot(x - a, y - b), 9), j) for h, j, a, b in pts if h == g and j != k)
        assert seen[g, k] == {j for _, j in others[:4]}


def test_validated_join_refuses(spark):
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (1, "c")], "k int, w string")
    with pytest.raises(relational.CardinalityError):
        relational.validated_join(one, two, ["k"], validate="many_to_one")
    assert relational.validated_join(one, two, ["k"], validate="one_to_many").count() == 2
    with pytest.raises(relational.CardinalityError):
        relational.validated_join(one, two.filter("k = 2"), ["k"], validate="one_to_one", all_left=True)
    with pytest.raises(ContractError):
        require(padded_or_null(spark.createDataFrame([(" x",)], "k string"), "k"), "padded")


def test_interval_sums_equal_prefix_sums(spark):
    rng = np.random.default_rng(1)
    start = datetime.date(2024, 1, 1)
    rain = rng.random((3, 40))
    daily = spark.createDataFrame([(s, start + datetime.timedelta(i), float(rain[s, i])) for s in range(3) for i in range(40)], "site int, date date, mm double")
    visits = spark.createDataFrame([(100 * s + i, s, start + datetime.timedelta(i)) for s in range(3) for i in (3, 20, 39)], "visit int, site int, date date")
    got = exposure.interval_sums(visits, daily, ["visit"], "site", "date", "mm", {"past": (1, 7), "with": (0, 6), "next": (-3, -1)})
    by = {r.visit: r for r in got.collect()}
    for s in range(3):
        for i in (3, 20, 39):
            r = by[100 * s + i]
            assert r.past == pytest.approx(rain[s, max(0, i - 7) : i].sum())
            assert r["with"] == pytest.approx(rain[s, max(0, i - 6) : i + 1].sum())
            assert r.next == pytest.approx(rain[s, i + 1 : i + 4].sum())


def test_rank_statistics(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 2.0), ("y", 0.0), ("y", 3.0)], "g string, v double")
    r = stats.mann_whitney(df, "g", "v", "x").first()
    greater = sum((a > b) + 0.5 * (a == b) for a in (1, 2, 2) for b in (0, 3))
    assert r.u == greater and r.cliffs_delta == pytest.approx((3 - 3) / 6)
    d = spark.createDataFrame([(v,) for v in (1.0, -2.0, 3.0, 0.0, 3.0)], "d double")
    w = stats.wilcoxon_w(d, "d").first()
    assert (w.n, w.w_plus, w.w_minus, w.w) == (4, 8.0, 2.0, 2.0)
    table = spark.createDataFrame([(3, 1, 1, 3), (0, 4, 2, 2)], "a long, b long, c long, d long")
    assert [round(x.p, 9) for x in table.select(stats.fisher_greater("a", "b", "c", "d").alias("p")).collect()] == [round(17 / 70, 9), 1.0]


def test_global_rank_equals_the_window(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(v)) for i, v in enumerate(rng.integers(0, 40, 500))] + [(900 + i, 7.0) for i in range(400)] + [(2000, None)]
    df = spark.createDataFrame(rows, "i int, v double")
    expected = {r.i: r.w for r in df.filter("v is not null").select("i", windows.average_rank("v").alias("w")).collect()}
    got = {r.i: r.rank for r in windows.global_average_rank(df, "v", buckets=16).collect()}
    assert got.pop(2000) is None and got == expected
    assert windows.global_average_rank(df.limit(0), "v").count() == 0


def test_ols_matches_numpy_and_reports_rank(spark):
    rng = np.random.default_rng(2)
    x, z, c = rng.random(80), rng.random(80), rng.integers(0, 8, 80)
    y = 1 + 2 * x - z + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(x, z, y, c)], "x double, z double, y double, c double")
    m = np.column_stack([np.ones(80), x, z])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    fit = stats.ols(df, "y", ["x", "z"], cluster="c")
    e = y - m @ beta
    scores = np.array([m[c == g].T @ e[c == g] for g in np.unique(c)])
    inv = np.linalg.inv(m.T @ m)
    g = len(scores)
    cov = inv @ scores.T @ scores @ inv * g / (g - 1) * 79 / 77
    assert fit["beta"] == pytest.approx(beta) and fit["se"] == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-6)
    assert stats.ols(df.withColumn("x2", F.col("x") * 2), "y", ["x", "x2"])["rank"] == 2
    part = linear.variance_partition(df, "y", ["x"], ["z"], [])
    assert sum(part.values()) == pytest.approx(1.0)
    joint = linear.joint_regression(df, "y", ["x", "z"])
    assert joint["valid"] and joint["f"] > 100


def test_gee_without_correlation_is_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = [(c, float(x), float(1 + x + u + rng.normal(0, 0.2))) for c in range(40) for u in [rng.normal()] for x in rng.random(5)]
    fit = linear.gee_exchangeable(spark.createDataFrame(rows, "c int, x double, y double"), "y", ["x"], "c")
    assert fit["beta"][1] == pytest.approx(1.0, abs=0.2) and 0.8 < fit["rho"] < 1
    single = spark.createDataFrame([(i, x, y) for i, (_, x, y) in enumerate(rows)], "c int, x double, y double")
    assert linear.gee_exchangeable(single, "y", ["x"], "c")["beta"] == pytest.approx(stats.ols(single, "y", ["x"])["beta"])


def test_binomial_glm_recovers_planted_slope(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        x = float(rng.normal())
        rows.append((i % 30, float(rng.binomial(50, 1 / (1 + math.exp(-(-0.5 + 0.8 * x))))), 50.0, x))
    fit = linear.binomial_glm(spark.createDataFrame(rows, "g int, k double, n double, x double"), "k", "n", ["x"], "g")
    assert fit["beta"] == pytest.approx([-0.5, 0.8], abs=0.06) and fit["rounds"] < 20


def test_trend_and_ordination(spark):
    x = np.linspace(0, 10, 30)
    resp = {"a": 2 + x - 0.3 * x**2, "b": 5 - x}
    df = spark.createDataFrame([(float(p), f, float(v[i])) for f, v in resp.items() for i, p in enumerate(x)], "p double, f string, y double")
    assert linear.trend_r2(df, "p", "f", "y").first().r2 == pytest.approx(1.0)
    square = spark.createDataFrame([(0, 1, 3.0), (0, 2, 4.0), (0, 3, 5.0), (1, 2, 5.0), (1, 3, 4.0), (2, 3, 3.0)], "i int, j int, distance double")
    co = linear.principal_coordinates(square, 1.0).collect()
    assert len(co) == 8 and all(r.retained == pytest.approx(1.0) for r in co)
    at = {(r.unit, r.axis): r.value for r in co}
    for i, j, gap in square.collect():
        assert math.dist([at[i, 1], at[i, 2]], [at[j, 1], at[j, 2]]) == pytest.approx(gap)
    with pytest.raises(ValueError):
        linear.principal_coordinates(square, most=3)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(12, 4)) @ np.diag([5, 2, 1, 0.5])
    long = spark.createDataFrame([(i, f"f{j}", float(m[i, j])) for i in range(12) for j in range(4)], "u int, f string, v double")
    got = {r.u: (r.pc1, r.pc2) for r in linear.principal_axes(long, "u", "f", "v").collect()}
    c = m - m.mean(axis=0)
    s = np.linalg.svd(c, full_matrices=False)
    assert np.abs([got[i][0] for i in range(12)]) == pytest.approx(np.abs(s[0][:, 0] * s[1][0]), abs=1e-6)


def test_graphical_lasso_limits():
    rng = np.random.default_rng(6)
    s = np.cov(rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)), rowvar=False)
    assert linear.graphical_lasso(s, 0.0, rounds=2000, tol=1e-10) == pytest.approx(np.linalg.inv(s), rel=1e-3, abs=1e-4)
    big = linear.graphical_lasso(s, 1e3)
    assert np.count_nonzero(np.abs(big - np.diag(np.diag(big))) > 1e-9) == 0


def test_network_without_edges_is_empty(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(u, f"f{f}", float(rng.normal())) for u in range(20) for f in range(4)], "u int, f string, v double")
    e = linear.network_edges(df, "u", "f", "v", [0.001, 50.0], draws=1)
    found = {(r.alpha, r.draw): r["count"] for r in e.groupBy("alpha", "draw").count().collect()}
    assert set(found) == {(0.001, 0), (0.001, 1)} and linear.calibrated_alpha(e, [0.001, 50.0], 1, least=100) == 50.0


def test_equivalence_verdicts():
    assert linear.tost(0.0, 0.1, 1.0, False)["verdict"] == "no_claim"
    assert linear.tost(0.0, 0.1, 1.0, True)["verdict"] == "equivalent"
    assert linear.tost(0.9, 0.3, 1.0, True)["verdict"] == "not_shown"
    assert linear.rope_mass(0.0, 1.0, 1.959963985) == pytest.approx(0.95, abs=1e-6)


def test_jackknife_interval_is_bounded():
    lo, hi = stats.jackknife_interval(0.9, [0.8, 0.9, 1.0, 0.95], 0.0, 1.0)
    assert 0 <= lo < 0.9 < hi <= 1.0


def test_transect_points_east(spark):
    df = spark.createDataFrame([(i, 18 + 0.01 * i, 45 + 0.1 * i) for i in range(20)], "k int, lat double, lon double")
    t = sorted((r.lon, r.transect_km) for r in spatial.transect(df, "lat", "lon").collect())
    assert all(a[1] < b[1] for a, b in zip(t, t[1:]))


def test_resampling_is_a_permutation_and_repeats(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "u int, g int, v double")
    p = resample.permuted(df, "u", "v", 3, 5, ["g"]).collect()
    for draw in range(3):
        for g in range(3):
            assert sorted(r.v for r in p if r.draw == draw and r.g == g) == [float(i) for i in range(30) if i % 3 == g]
    b = callback.bootstrap(df, "g", {"n": F.count(F.lit(1)), "m": F.avg("v")}, 5, 1)
    assert {r.n for r in b.collect()} == {30}


def test_translation_table(spark):
    rows = [("GTGAAATAA", True), ("GTGAAATAA", False), ("ATGTAGAAA", True), ("ATGNNN", True), ("ATGA", True)]
    got = spark.createDataFrame(rows, "s string, c boolean").select(ids.translate_cds(F.col("s"), F.col("c")).alias("t")).collect()
    assert [tuple(r.t) for r in got] == [("ok", "MK", 0), ("ok", "VK", 0), ("ok", "M*K", 1), ("ok", "MX", 0), ("length_not_multiple_of_three", None, None)]


def test_file_formats(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("# Constructed from biom file\n#OTU ID\ts1\tEB1\ts2\tTaxon\nf1\t3\t9\t0\tK;P\nf2\t0\t0\t2.0\tNA\n")
    long = sorted(map(tuple, io.read_wide_tsv(spark, f"{tmp_path}/w.tsv").collect()))
    assert long == [("f1", "s1", 3.0), ("f2", "s2", 2.0)]
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write("k\tv\na\tNA\nb\t\n")
    assert [tuple(r) for r in io.read_tsv(spark, f"{tmp_path}/x.tsv.gz").collect()] == [("a", "NA"), ("b", None)]
    (tmp_path / "many").mkdir()
    for s in ("p1", "p2"):
        (tmp_path / "many" / f"{s}.tsv").write_text("g\tx\ng1\t1\n")
    many = io.read_collection(spark, f"{tmp_path}/many")
    assert sorted(r.sample for r in many.collect()) == ["p1", "p2"]
    assert [tuple(r) for r in io.require_one_each(many, "sample", ["p1", "p3"]).collect()] == [("p3", 0)]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "w.tsv", "inner/w.tsv")
    import hashlib

    members = io.tar_members(spark, f"{tmp_path}/a.tar.gz").collect()
    assert [(m.member, m.sha256) for m in members] == [("inner/w.tsv", hashlib.sha256((tmp_path / "w.tsv").read_bytes()).hexdigest())]
    df = spark.createDataFrame([(1, 0.1 + 0.2, True, None), (2, float("inf"), None, "x")], "a int, b double, c boolean, d string")
    io.write_tsv(df.coalesce(1), f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert text == ["a\tb\tc\td", "1\t0.3\ttrue\t", "2\t\t\tx"]
    files = io.manifest(spark, f"{tmp_path}/w.tsv")
    lock = files.select("path", F.lit("0").alias("sha256")).union(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    assert sorted(r.violation for r in io.unpinned(files, lock).collect()) == ["changed", "missing"]


def test_sequence_formats(spark):
    df = spark.createDataFrame([(">lcl|c1 note\nACG\nta\n>c2\nGG\n", "@r\nacgt\n+\n!!!!\n@q\nGG\n+\n!!\n")], "fa string, fq string")
    r = df.select(io.fasta(F.col("fa")).alias("a"), io.fastq(F.col("fq")).alias("q")).first()
    assert [tuple(x) for x in r.a] == [("c1", "ACGTA"), ("c2", "GG")] and r.q == ["ACGT", "GG"]


def test_streaming_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(k, t + datetime.timedelta(hours=7 * i), float(i)) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, t timestamp, v double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for made, name in ((lambda d: streaming.windowed_sums(d, "k", "t", "v"), "w"), (lambda d: streaming.sessions(d, "k", "t", "8 hours"), "s")):
        q = made(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, made(df).collect()))
    visits = df.filter("v % 5 = 0").select(F.col("k"), F.col("t").alias("at"))
    joined = streaming.interval_join(visits, df, "k", "at", "t", "1 day").count()
    assert joined == sum(1 for k, a, v in rows if v % 5 == 0 for q, b, _ in rows if q == k and a - datetime.timedelta(days=1) < b <= a)


def test_network_calibration_reads_all_brands(spark):
    from varve.operators import linear as li
    from varve.plans.base import sites
    from varve.plans.models import QUERIES

    d = "/root/testdata/sf0.001"
    whole = sites(spark, d).withColumn("unit", F.concat_ws("|", "site", "position"))
    edges = li.network_edges(whole, "unit", "feature", "count", [0.1, 0.2, 0.4], draws=2)
    got = QUERIES["ss_31_32_network_calibration"][0](spark, d)
    assert {(r.alpha, r.draw): r.edges for r in got.collect()} == {(r.alpha, r.draw): r["count"] for r in edges.groupBy("alpha", "draw").count().collect()}


def test_pins_tell_missing_empty_and_changed_apart(spark, tmp_path):
    import hashlib

    for name, content in (("good", b"x"), ("bad", b"y"), ("none", b"")):
        (tmp_path / name).write_bytes(content)
    short = F.regexp_extract("path", "[^/]+$", 0)
    files = io.manifest(spark, str(tmp_path)).withColumn("path", short)
    empty = io.empty_files(spark, str(tmp_path)).withColumn("path", short)
    lock = spark.createDataFrame([(n, hashlib.sha256(b"x").hexdigest()) for n in ("good", "bad", "none", "gone")], "path string, sha256 string")
    assert {tuple(r) for r in io.unpinned(files, lock, empty).collect()} == {("bad", "changed"), ("none", "empty"), ("gone", "missing")}
    assert {tuple(r) for r in io.unpinned(files, lock).collect()} == {("bad", "changed"), ("none", "missing"), ("gone", "missing")}
