"""Ranks, quantiles and step-up tests by ranges against plain versions; streams against batches; user functions."""

import datetime
import random
import shutil
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varve.functions.udtf import records
from varve.operators import callback, resample, windows
from varve.streaming import exposure, stateful


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows, with ties, nulls in the value and in the group."""
    rng = np.random.default_rng(1)
    rows = [(k, "hot" if rng.random() < 0.8 else None if rng.random() < 0.3 else "cold", None if rng.random() < 0.05 else float(rng.integers(0, 200)) / 200) for k in range(900)]
    return rows, spark.createDataFrame(rows, "k long, g string, v double").repartition(5)


def groups(rows):
    out = {}
    for k, g, v in rows:
        out.setdefault(g, []).append((k, v))
    return out


def test_grouped_ranks_and_quantiles(hot):
    rows, df = hot
    got = {r.k: r.r for r in windows.ranked(df, "v", ["g"], "r").collect()}
    q = {r.g: (r.a, r.b) for r in windows.grouped_quantiles(df, "v", {"a": 0.5, "b": 0.975}, ["g"]).collect()}
    for g, members in groups(rows).items():
        known = np.array([v for _, v in members if v is not None])
        for k, v in members:
            want = None if v is None else (known < v).sum() + ((known == v).sum() + 1) / 2
            assert got[k] == want
        assert q[g] == pytest.approx(tuple(np.quantile(known, [0.5, 0.975])))
    assert len(got) == len(rows)
    assert windows.grouped_quantiles(df.limit(0), "v", {"a": 0.5}, ["g"]).count() == 0


@pytest.mark.parametrize("by, buckets", [((), 256), (("g",), 256), (("g",), 5)])
def test_step_up_by_ranges(hot, by, buckets):
    rows, df = hot
    got = {r.k: r.q for r in windows.benjamini_hochberg(df, "v", by, buckets=buckets).collect()}
    for members in (groups(rows) if by else {None: [(k, v) for k, _, v in rows]}).values():
        p = sorted((v, k) for k, v in members if v is not None)
        n, least, want = len(p), 1.0, {}
        for i in range(n - 1, -1, -1):
            least = min(least, p[i][0] * n / (i + 1))
            want[p[i][1]] = least
        for k, v in members:
            assert got[k] == (None if v is None else pytest.approx(want[k]))
    assert windows.benjamini_hochberg(df.limit(0), "v", by).count() == 0


def test_no_task_orders_a_whole_group(hot):
    _, df = hot
    plan = windows.benjamini_hochberg(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and "__b" in plan


def test_multiplicities_sum_to_the_units(spark):
    df = spark.createDataFrame([(f"s{k % 12}",) for k in range(50)], "s string")
    got = resample.multiplicities(df, "s", 6, 2).groupBy("draw").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("u")).collect()
    assert len(got) == 6 and all(r.n == 12 and r.u <= 12 for r in got)


def plain_spells(rows, least, mark):
    days = {}
    for k, t, v in rows:
        days[k, t.date()] = days.get((k, t.date()), 0.0) + v
    out = []
    one = datetime.timedelta(days=1)
    for (k, d), v in days.items():
        if v >= least and days.get((k, d - one), 0.0) < least:
            last, total = d, v
            while days.get((k, last + one), 0.0) >= least:
                last += one
                total += days[k, last]
            if datetime.datetime.combine(last + 2 * one, datetime.time()) <= mark:
                out.append((k, d, last, (last - d).days + 1, total))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_spells_of_a_shuffled_stream_equal_the_batch(spark, tmp_path, files):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{rng.randrange(4)}", start + datetime.timedelta(hours=rng.randrange(24 * 40)), float(rng.randrange(5))) for _ in range(200)]
    # within a file any order; later files hold later days, two days' delay covers where they meet
    rows.sort(key=lambda r: r[1])
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, "k string, t timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, t timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out, late = stateful.run_available(stateful.spells(stream, "k", "t", "v", 3.0), str(tmp_path))
    mark = max(t for _, t, _ in rows) - datetime.timedelta(days=2)
    assert late == 0
    assert sorted(tuple(r) for r in out.collect()) == plain_spells(rows, 3.0, mark)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    for i, hours in enumerate(([0, 1, 240], [250], [2, 480])):
        spark.createDataFrame([("a", t + datetime.timedelta(hours=h), 1.0) for h in hours], "k string, t timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    (tmp_path / "in").mkdir()
    for i in range(3):
        for f in (tmp_path / f"in{i}").glob("part*"):
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
        time.sleep(1.1)
    stream = spark.readStream.schema("k string, t timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out, late = stateful.run_available(exposure.windowed_sums(stream, "k", "t", "v"), str(tmp_path))
    assert late == 1
    assert {(str(r.start)[:10], r.n) for r in out.collect()} >= {("2024-01-01", 2), ("2024-01-11", 2)}


def test_duplicates_within_the_watermark_leave_once(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(k % 10, t + datetime.timedelta(minutes=k), k) for k in range(40)]
    spark.createDataFrame(rows, "id long, t timestamp, v long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, t timestamp, v long").parquet(f"{tmp_path}/in")
    out, _ = stateful.run_available(stateful.deduplicated(stream, ["id"], "t"), str(tmp_path))
    assert sorted(r.id for r in out.collect()) == list(range(10))


def test_array_statistics_of_groups(hot):
    rows, df = hot
    trimmed = callback.array_statistic(callback.trimmed_mean)
    got = {r.g: r.t for r in callback.statistic(df, {"t": trimmed("v")}, ["g"]).collect()}
    for g, members in groups(rows).items():
        known = sorted(v for _, v in members if v is not None)
        cut = int(len(known) * 0.1)
        assert got[g] == pytest.approx(np.mean(known[cut : len(known) - cut]))
    none = callback.statistic(df.filter("v IS NULL"), {"t": trimmed("v")}, ["g"]).collect()
    assert none and all(r.t is None for r in none)
    assert callback.trimmed_mean(pa.array([3.0])) == 3.0


def test_records_of_a_partitioned_table(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 9), ("b", 1, None), ("b", 2, -1), ("b", 3, -1)], "g string, t int, v int")
    got = records(df.asTable().partitionBy("g").orderBy("t"), F.lit("v"))
    assert got.columns == ["g", "t", "v", "record", "before"]
    assert sorted(tuple(r) for r in got.select("g", "t", "record", "before").collect()) == [("a", 1, 5, None), ("a", 3, 9, 5), ("b", 2, -1, None)]
    with pytest.raises(Exception, match="no column"):
        records(df.asTable().partitionBy("g").orderBy("t"), F.lit("w")).collect()
