"""The similarity join against all pairs, and how many pairs it compares on planted duplicates."""

import numpy as np
import pytest

from varve.operators import relational


def frame(spark, vectors, labels=None):
    rows = [(f"r{k:04d}", [float(x) for x in v], int(labels[k]) if labels is not None else 0) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, v array<double>, label int").repartition(3)


def brute(x, y, threshold, lx=None, ly=None):
    with np.errstate(invalid="ignore"):
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    c = a @ b.T
    return {(f"r{i:04d}", f"r{j:04d}"): c[i, j] for i, j in zip(*np.nonzero(c >= threshold)) if lx is None or lx[i] == ly[j]}


@pytest.mark.parametrize("threshold", [0.2, 0.7, 0.999])
def test_no_pair_is_lost(spark, threshold):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 6)), rng.normal(size=(80, 6))
    y[:20] = x[:20] * rng.uniform(0.1, 9, (20, 1)) + rng.normal(size=(20, 6)) * 0.01
    x[5] = 0
    lx, ly = rng.integers(0, 2, 60), rng.integers(0, 2, 80)
    got = relational.similar_pairs(frame(spark, x, lx), frame(spark, y, ly), "id", "v", threshold, ["label"], pivots=7).collect()
    want = brute(x, y, threshold, lx, ly)
    assert {(r.i, r.j): pytest.approx(r.similarity) for r in got} == want and len(got) == len(want)


def test_compared_pairs_grow_with_the_duplicates_not_with_the_square(spark):
    """Twice the groups of near copies: about twice the pairs compared, a small part of all."""
    rng = np.random.default_rng(2)
    compared = []
    for groups in (20, 40):
        centres = rng.normal(size=(groups, 16))
        x, y = (np.repeat(centres, 8, axis=0) + rng.normal(size=(groups * 8, 16)) * 0.01 for _ in range(2))
        a, b = frame(spark, x), frame(spark, y)
        compared.append(relational.similar_candidates(a, b, "id", "v", 0.995, pivots=64).count())
        got = relational.similar_pairs(a, b, "id", "v", 0.995, pivots=64).count()
        assert got == len(brute(x, y, 0.995)) == groups * 64
        assert compared[-1] < 0.25 * (groups * 8) ** 2
    assert compared[1] < 3 * compared[0]


def test_nothing_to_join(spark):
    one = frame(spark, np.ones((2, 3)))
    none, zero = one.limit(0), frame(spark, np.zeros((2, 3)))
    for a, b in ((none, one), (one, none), (one, zero), (zero, one)):
        assert relational.similar_pairs(a, b, "id", "v", 0.5).count() == 0
        assert relational.similar_pairs(a, b, "id", "v", 0.5, ["label"]).count() == 0
