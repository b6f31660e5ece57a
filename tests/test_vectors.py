"""Pairs of vectors in tiles, against all pairs; odd vectors against the SQL of the queries."""

import numpy as np
import pyarrow as pa
import pytest
from test_odd_tables import against_sql, line_tables  # noqa: F401

from varve.operators import relational, vectors


def frame(spark, v, labels=None):
    rows = [(k, [float(x) for x in r], int(labels[k]) if labels is not None else 0) for k, r in enumerate(v)]
    return spark.createDataFrame(rows, "id long, v array<float>, label int").repartition(3)


@pytest.mark.parametrize("side", [7, 4096])
def test_distances_of_all_tiles(spark, side):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    x[30:40] = x[:10] + np.float32(1e-4)
    e = frame(spark, x)
    got = vectors.distances(e.filter("id % 4 = 0"), e, "id", "v", 6, side).collect()
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    assert {(r.i, r.j): r.distance for r in got} == {(i, j): pytest.approx(round(d[i, j], 6), abs=1e-12) for i in range(0, 60, 4) for j in range(60) if i != j}
    assert len(got) == 15 * 59


@pytest.mark.parametrize("side", [7, 4096])
def test_pairs_and_members_of_all_tiles(spark, side, monkeypatch):
    monkeypatch.setattr(vectors, "PAIRS", 16)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(90, 4))
    lx, ly = rng.integers(0, 3, 50), rng.integers(0, 3, 90)
    c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    want = {(i, j): pytest.approx(c[i, j], abs=1e-6) for i in range(50) for j in range(90) if lx[i] == ly[j] and c[i, j] >= 0.8}
    a, b = frame(spark, x, lx), frame(spark, y, ly)
    got = vectors.alike(a, b, "id", "v", 0.8, ["label"], side).collect()
    assert {(r.i, r.j): r.similarity for r in got} == want and len(got) == len(want)
    members = [r.id for r in vectors.with_alike(a, b, "id", "v", 0.8, ["label"], side).collect()]
    assert sorted(members) == sorted({i for i, _ in want})


def test_pairs_are_not_met_one_by_one(spark):
    """No plan holds a join of rows of both sides: rows meet as blocks, each as often as there are blocks of the other side."""
    rng = np.random.default_rng(5)
    e = frame(spark, rng.normal(size=(40, 4)))
    for df in (vectors.distances(e, e, "id", "v", 6), vectors.alike(e, e, "id", "v", 0.3), relational.similar_pairs(e, e, "id", "v", 0.3), relational.similar_pairs(e, e, "id", "v", 0.9)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PythonMapInArrow" in plan or "MapInArrow" in plan
        assert "zip_with(v" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("query", ["dv_14_euclidean_distances", "jn_19_similar_duplicates", "jn_19_similarity_join"])
def test_odd_vectors_as_in_sql(against_sql, query):  # noqa: F811
    rng = np.random.default_rng(6)
    n = 120
    v = [rng.normal(size=6).tolist() for _ in range(n)]
    for k in range(0, 40, 3):
        v[k + 1] = v[k]
    labels = [k % 3 for k in range(n)]
    if query.startswith("dv_14"):
        v[50], v[3], v[4], v[5], v[6] = [1.0, None, 2.0], None, [None] * 6, [1e20] * 6, [1.0] * 9
        labels[7] = None
    else:
        labels[7] = labels[8] = None
    ids = [*range(n - 1), None]
    t = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(v, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    assert against_sql(query, embeddings=t)


@pytest.mark.parametrize("side,members", [(5, 3), (4096, 1024)])
def test_keys_that_share_a_member(spark, side, members):
    rng = np.random.default_rng(7)
    a = {k: {f"m{x}" for x in rng.integers(0, 30, rng.integers(1, 4))} for k in range(40)}
    b = {k: {f"m{x}" for x in rng.integers(0, 30, rng.integers(1, 4))} for k in range(1000, 1060)}
    a[40], b[2000] = a[3], b[1000]
    frames = [spark.createDataFrame([(k, m) for k, s in t.items() for m in s] + [(next(iter(t)), None)], "key long, m string") for t in (a, b)]
    got = vectors.meeting(*frames, "key", "m", side, members).collect()
    assert {r.key: r.n for r in got} == {k: sum(bool(s & t) for t in b.values()) for k, s in a.items()} and len(got) == len(a)


def test_spillover_is_counted_by_classes_of_sets(against_sql, spark, monkeypatch):  # noqa: F811
    """Sixty profiles of three sets of features: three classes meet, not profiles."""
    rows = []
    for s in range(0, 120, 2):
        brands = [("a", "b"), ("b", "c"), ("d",)][s % 3]
        for x in brands:
            rows += [(1995, s + s % 3, p, x, kind, reads) for p, kind, reads in (("N" if s % 5 else "A", "STANDARD", 46 if s % 4 else 3), ("R" if s % 7 else "A", "ECONOMY", 50))]
    rows += [(1995, 500, "N", "alone", "STANDARD", 50), (1995, 501, "N", "a", "STANDARD", 50), (1995, 502, "R", "a", "ECONOMY", 5), (1995, 503, None, "a", "STANDARD", 50)]
    met = []
    inner = vectors.met
    monkeypatch.setattr(vectors, "met", lambda a, b, *rest: met.append((a.count(), b.count())) or inner(a, b, *rest))
    got = against_sql("ss_24_spillover_trace", **line_tables(rows))
    assert len(got) > 20 and 500 not in {r[0] for r in got}
    assert len(met) == 3 and all(x <= 5 and y <= 7 for x, y in met)
