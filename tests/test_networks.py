"""Networks: correlations by brute force, coefficients by their optimality conditions, planted edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import networks


def planted(seed=1, sites=40, campaigns=3):
    """Features a-b are positively and c-d negatively tied in one compartment, none in the other."""
    rng = np.random.default_rng(seed)
    rows = []
    for comp in ("deep", "top"):
        for c in range(campaigns):
            for s in range(sites):
                v = rng.normal(size=8) + 0.5 * c
                if comp == "deep":
                    v[1] = v[0] + 0.4 * rng.normal()
                    v[3] = -v[2] + 0.4 * rng.normal()
                rows += [(comp, c, f"s{s}", f, float(x)) for f, x in zip("abcdefgh", v)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    z = spark.createDataFrame(planted(), "compartment string, campaign long, site string, f string, v double")
    mean = F.avg("v").over(networks.over(["compartment", "campaign", "f"]))
    return z.withColumn("v", F.col("v") - mean)


def test_observed_correlations_are_those_of_numpy(spark, table):
    got = {(r.compartment, r.i, r.j): r.r for r in networks.correlations(table, "observed", 0, 1).collect()}
    rows = table.collect()
    for comp in ("deep", "top"):
        m = np.array([[r.v for r in sorted((x for x in rows if x.compartment == comp and x.f == f), key=lambda x: (x.campaign, x.site))] for f in "abcdefgh"])
        want = np.corrcoef(m)
        for i, a in enumerate("abcdefgh"):
            for j in range(i, 8):
                assert got[comp, a, "abcdefgh"[j]] == pytest.approx(want[i, j], abs=1e-9)


def test_null_keeps_each_feature_and_breaks_ties(table):
    r = networks.correlations(table, "null", 4, 1).filter("i = 'a' AND j = 'b' AND compartment = 'deep'").collect()
    assert len(r) == 4 and max(abs(x.r) for x in r) < 0.35 and len({round(x.r, 9) for x in r}) == 4
    assert networks.correlations(table, "bootstrap", 4, 1).filter("i = 'a' AND j = 'b' AND compartment = 'deep' AND r > 0.85").count() == 4


def test_neighbourhood_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 7))
    x[:, 1] += x[:, 0]
    s = np.corrcoef(x.T)
    alphas = [0.05, 0.3, 0.15]
    for k in (0, 4):
        for alpha, b in zip(alphas, networks.neighbourhood(s, k, alphas)):
            gradient = s[:, k] - s @ b
            for j in range(7):
                if j == k:
                    assert b[j] == 0
                elif b[j]:
                    assert gradient[j] == pytest.approx(alpha * np.sign(b[j]), abs=1e-5)
                else:
                    assert abs(gradient[j]) <= alpha + 1e-6


def test_planted_edges_are_stable_and_no_others(table, monkeypatch):
    monkeypatch.setattr(networks, "CHUNK", 3)
    alpha, found = networks.calibrated_network(table.filter("compartment = 'deep'"), [0.05, 0.2, 0.4], 5, 8, 3)
    rows = found.collect()
    assert alpha in (0.2, 0.4)
    assert {(r.i, r.j, r.weight > 0) for r in rows if r.stable} == {("a", "b", True), ("c", "d", False)}
    assert all(r.stability == 1 and r.sign_share == 1 for r in rows if r.stable)
    got = {r.compartment: r for r in networks.summary(found, table).collect()}
    assert got["deep"].stable_edges == ["a~b", "c~d"] and got["deep"].density == round(2 * got["deep"].edges / 56, 6)
    assert (got["top"].edges, got["top"].stable, got["top"].stable_edges) == (0, 0, [])


def test_no_penalty_passes_without_ties_and_bounds_are_checked(table):
    alpha, found = networks.calibrated_network(table.filter("compartment = 'top'"), [0.4, 0.6], 3, 3, 3)
    assert alpha is None and found.filter("stable").count() == 0
    with pytest.raises(ValueError):
        networks.edges(networks.correlations(table, "observed", 0, 1), [0.2], most=3)
    assert networks.edges(networks.correlations(table.limit(0), "observed", 0, 1), [0.2]).count() == 0
