"""Window operators and time-lag exposures over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import exposure as ex
from varve.operators import windows as win
from varve.plans.base import SQL_COUNTS, SQL_DAILY, SQL_LINES, counts, daily, lines, visits
from varve.session import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_CELL = f"{SQL_COUNTS}, cell AS (SELECT campaign, site, position, sum(count)::DOUBLE AS v FROM counts GROUP BY ALL)"


def _cell(spark, d):
    return counts(spark, d).groupBy("campaign", "site", "position").agg(F.sum("count").cast("double").alias("v"))


@query(f"""WITH {_CELL} SELECT campaign, site, position, round(coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0), 6) AS z,
  round(v - avg(v) OVER (PARTITION BY campaign, position), 6) AS c, round(1.0::DOUBLE / count(*) OVER (PARTITION BY site), 6) AS weight FROM cell WINDOW w AS (PARTITION BY campaign)""")
def wn_1_2_3_score_centre_weight(spark, d):
    z = F.round(win.zscore("v", ["campaign"]), 6).alias("z")
    c = F.round(win.centred("v", ["campaign", "position"]), 6).alias("c")
    return _cell(spark, d).select("campaign", "site", "position", z, c, F.round(win.group_weight(["site"]), 6).alias("weight"))


@query("SELECT o_orderkey, date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS days FROM orders")
def wn_4_days_since_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", win.days_since_first("o_orderdate", ["o_custkey"]).cast("long").alias("days"))


@query(f"WITH {_CELL} SELECT campaign, site, position, rank() OVER (PARTITION BY campaign ORDER BY v) + (count(*) OVER (PARTITION BY campaign, v) - 1) / 2.0::DOUBLE AS rank FROM cell")
def wn_6_average_rank(spark, d):
    return _cell(spark, d).select("campaign", "site", "position", win.average_rank("v", ["campaign"]).alias("rank"))


_P = "p AS (SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id * 7919 % 1009) / 1009.0::DOUBLE END AS p FROM events)"


def _p(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", "event_type", F.when(F.col("event_id") % 17 != 0, (F.col("event_id") * 7919 % 1009) / 1009.0).alias("p"))


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p NULLS LAST) AS i, count(p) OVER (PARTITION BY event_type) AS n FROM p)
  SELECT event_id, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * n / i) OVER (PARTITION BY event_type ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) END, 9) AS q,
   round(CASE WHEN p IS NOT NULL THEN least(1, p * n) END, 9) AS bonferroni FROM r""")
def wn_7_8_ss_41_multiple_testing(spark, d):
    df = _p(spark, d).withColumn("bonferroni", F.when(F.col("p").isNotNull(), F.round(win.bonferroni("p", ["event_type"]), 9)))
    df = win.benjamini_hochberg(df, "p", ["event_type"])
    return df.select("event_id", F.round("q", 9).alias("q"), "bonferroni")


@query(f"WITH {SQL_DAILY} SELECT site, date, round(sum(mm) OVER (PARTITION BY site ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS total FROM daily")
def wn_9_running_sum(spark, d):
    return daily(spark, d).select("site", "date", F.round(win.running_sum("mm", ["site"], "date"), 6).alias("total"))


@query(f"""WITH {SQL_DAILY}, a AS (SELECT site, date, mm >= 20 AS wet FROM daily), b AS (SELECT *, CASE WHEN lag(wet) OVER w IS DISTINCT FROM wet THEN 1 ELSE 0 END AS c FROM a WINDOW w AS (PARTITION BY site ORDER BY date)),
  r AS (SELECT *, sum(c) OVER (PARTITION BY site ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM b)
  SELECT site, min(date) AS first, max(date) AS last, count(*) AS length FROM r WHERE wet GROUP BY site, run""")
def wn_10_runs(spark, d):
    df = daily(spark, d).withColumn("wet", F.col("mm") >= 20)
    return win.runs(df, "wet", ["site"], "date").select("site", "first", "last", "length")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def wn_11_first_per_key(spark, d):
    return win.first_per_key(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey, (floor((row_number() OVER w - 1) * 6 / count(*) OVER (PARTITION BY c_mktsegment)))::BIGINT AS floor_block, ntile(6) OVER w - 1 AS even_block
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)""")
def wn_12_contiguous_blocks(spark, d):
    by, order = ["c_mktsegment"], ("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", win.floor_blocks(6, by, *order).cast("long").alias("floor_block"), win.even_blocks(6, by, *order).cast("long").alias("even_block")
    )


@query("""WITH e AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM events)
  SELECT decile, count(*) AS n FROM (SELECT len(list_filter(edges, lambda x: value >= x)) AS decile FROM events, e) GROUP BY 1""")
def wn_13_quantile_bins(spark, d):
    ev = table(spark, d, "events").select("value")
    edges = win.quantile_edges(ev, "value", 10)
    df = ev.crossJoin(F.broadcast(edges)).select(win.digitise(F.col("value"), F.col("edges")).cast("long").alias("decile"))
    return df.groupBy("decile").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, coalesce(max(f) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(f) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) = 1 AS near
  FROM (SELECT conv_id, turn, (length(text) > 400)::INT AS f FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def wn_14_near_flag(spark, d):
    df = table(spark, d, "conversations").withColumn("f", F.length("text") > 400)
    return df.select("conv_id", "turn", win.near_flag("f", 2, ["conv_id"], "turn").alias("near"))


@query("SELECT c_custkey, round((sum(c_acctbal) OVER w - c_acctbal) / (count(*) OVER w - 1), 6) AS others FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def wn_16_leave_one_out(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(win.leave_one_out_mean("c_acctbal", ["c_mktsegment"]), 6).alias("others"))


_W = {"w1": (0, 0), "w3": (0, 2), "w7": (0, 6), "lag1_3": (1, 3), "lag4_7": (4, 7), "next3": (-3, -1)}


@query(
    f"WITH {SQL_DAILY} SELECT visit, "
    + ", ".join(f"round(coalesce(sum(mm) FILTER (WHERE date_diff('day', d.date, v.date) BETWEEN {a} AND {b}), 0), 6) AS {k}" for k, (a, b) in _W.items())
    + " FROM visits v LEFT JOIN daily d ON v.site = d.site AND d.date BETWEEN v.date - 7 AND v.date + 3 GROUP BY visit"
)
def jn_9_10_interval_exposures(spark, d):
    df = ex.interval_sums(visits(spark, d), daily(spark, d), ["visit"], "site", "date", "mm", _W)
    return df.select("visit", *[F.round(k, 6).alias(k) for k in _W])


@query(f"""WITH {SQL_DAILY}, g AS (SELECT visit, site, date, lag FROM visits, range(1, 11) r(lag)), past AS (SELECT g.*, coalesce(d.mm, 0) AS mm FROM g LEFT JOIN daily d ON g.site = d.site AND d.date = g.date - lag::INT)
  SELECT visit, peak::DOUBLE AS peak, round(sum(mm * (lag / peak) * exp(1 - lag / peak)), 6) AS exposure FROM past, (VALUES (0.5::DOUBLE), (2.0), (7.0)) p(peak) GROUP BY ALL""")
def jn_12_sc_13_pulse_exposure(spark, d):
    lag = ex.lag_table(visits(spark, d), daily(spark, d), "visit", "site", "date", "mm", 10)
    df = lag.withColumn("peak", F.explode(F.array(*[F.lit(x) for x in (0.5, 2.0, 7.0)])))
    return df.groupBy("visit", "peak").agg(F.round(F.sum(F.col("mm") * ex.pulse(F.col("lag"), F.col("peak"))), 6).alias("exposure"))


@query("""WITH p AS (SELECT user_id % 20 AS cohort, round(1 + avg(value) / 10, 4) AS peak FROM events GROUP BY 1), g AS (SELECT cohort, peak, x * peak / 1000.0::DOUBLE AS t FROM p, range(1000, 20001) r(x)),
  k AS (SELECT cohort, peak, t, t / peak * exp(1 - t / peak) AS v FROM g) SELECT cohort, peak, round(min(t) FILTER (WHERE v <= 0.5), 6) AS half, round(min(t) FILTER (WHERE v <= 0.1), 6) AS tenth FROM k GROUP BY ALL""")
def sc_14_decay_times(spark, d):
    """When a pulse that peaks at a cohort's own time has decayed to a half and to a tenth, on a grid of thousandths of the peak."""
    peaks = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("cohort")).agg(F.round(1 + F.avg("value") / 10, 4).alias("peak"))
    grid = peaks.withColumn("x", F.explode(F.sequence(F.lit(1000), F.lit(20000)))).withColumn("t", F.col("x") * F.col("peak") / 1000.0)
    k = grid.withColumn("v", ex.pulse(F.col("t"), F.col("peak")))
    first = lambda y: F.round(F.min(F.when(F.col("v") <= y, F.col("t"))), 6)
    return k.groupBy("cohort", "peak").agg(first(0.5).alias("half"), first(0.1).alias("tenth"))


@query(f"""WITH {_CELL}, w AS (SELECT campaign, site, max(v) FILTER (WHERE position = 'A') AS a, max(v) FILTER (WHERE position = 'R') AS r FROM cell GROUP BY ALL)
  SELECT campaign, site, a - r AS difference, (a + r) / 2 AS half_sum FROM w WHERE a IS NOT NULL AND r IS NOT NULL""")
def cx_15_paired_response(spark, d):
    w = _cell(spark, d).groupBy("campaign", "site").pivot("position", ["A", "R"]).agg(F.max("v")).dropna(subset=["A", "R"])
    return w.select("campaign", "site", (F.col("A") - F.col("R")).alias("difference"), ((F.col("A") + F.col("R")) / 2).alias("half_sum"))


@query(f"""WITH {SQL_DAILY} SELECT v.site, round(sum(mm), 6) AS total, count(DISTINCT d.date) AS days, count(DISTINCT v.site % 7) = 1 AS one_cell FROM visits v JOIN daily d ON v.site = d.site AND d.date BETWEEN v.date - 4 AND v.date - 1 GROUP BY v.site""")
def cx_16_event_window(spark, d):
    v, w = visits(spark, d), daily(spark, d).select(F.col("site").alias("s"), F.col("date").alias("e"), "mm")
    df = v.join(w, (F.col("site") == F.col("s")) & F.datediff("date", "e").between(1, 4))
    return df.groupBy("site").agg(F.round(F.sum("mm"), 6).alias("total"), F.countDistinct("e").alias("days"), (F.countDistinct(F.col("site") % 7) == 1).alias("one_cell"))


@query("SELECT event_type, min(ts::DATE)::VARCHAR AS first, max(ts::DATE)::VARCHAR AS last, count(*) AS n FROM events GROUP BY 1")
def cx_2_date_profile(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, d, "events").groupBy("event_type").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n"))


_PLACEBO = {"future": (-30, -1), "remote": (180, 365)}


@query(
    f"WITH {SQL_DAILY} SELECT visit, "
    + ", ".join(f"round(coalesce(sum(mm) FILTER (WHERE date_diff('day', d.date, v.date) BETWEEN {a} AND {b}), 0), 6) AS {k}" for k, (a, b) in _PLACEBO.items())
    + " FROM visits v LEFT JOIN daily d ON v.site = d.site GROUP BY visit"
)
def rm_13_placebo_exposures(spark, d):
    df = ex.interval_sums(visits(spark, d), daily(spark, d), ["visit"], "site", "date", "mm", _PLACEBO)
    return df.select("visit", *[F.round(k, 6).alias(k) for k in _PLACEBO])


@query(f"WITH {SQL_LINES}, m AS (SELECT site, count(DISTINCT campaign) AS n FROM lines GROUP BY site) SELECT count(*) AS sites, min(n) AS least, max(n) AS most, count(DISTINCT n) = 1 AS balanced FROM m")
def cx_3_balanced_panel(spark, d):
    m = lines(spark, d).groupBy("site").agg(F.countDistinct("campaign").alias("n"))
    return m.agg(F.count("*").alias("sites"), F.min("n").alias("least"), F.max("n").alias("most"), (F.countDistinct("n") == 1).alias("balanced"))
