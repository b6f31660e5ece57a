"""Statistics and resampling over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import relational as rel
from varve.operators import resample as rs
from varve.operators import stats as st
from varve.operators import vectors
from varve.operators import windows as win
from varve.plans.base import SQL_COUNTS, SQL_LINES, SQL_SITES, counts, lines, sites
from varve.plans.diversity import _DENSE, _SITE, _site, dense
from varve.plans.relational import _KNN, points
from varve.session import durable, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT event_type, round(corr(value, user_id), 6) AS r, round(regr_slope(value, user_id), 9) AS slope FROM events GROUP BY 1")
def ss_1_5_pearson_slope(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.corr("value", "user_id"), 6).alias("r"), F.round(st.slope("user_id", "value"), 9).alias("slope"))


_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE"


@query(f"""WITH r AS (SELECT c_mktsegment, {_RANK.format(by="c_mktsegment", x="c_nationkey")} AS x, {_RANK.format(by="c_mktsegment", x="c_acctbal")} AS y FROM customer)
  SELECT c_mktsegment, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def ss_2_spearman(spark, d):
    s = st.spearman(table(spark, d, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"])
    return s.select("c_mktsegment", "n", F.round("rho", 6).alias("rho"))


@query(f"""WITH {_DENSE}, g AS (SELECT site, feature, sum(count) AS c FROM dense GROUP BY ALL), r AS (SELECT feature, {_RANK.format(by="feature", x="c")} AS x, {_RANK.format(by="feature", x="site % 7")} AS y FROM g)
  SELECT feature, round(corr(x, y), 6) AS rho FROM r GROUP BY feature""")
def ss_4_feature_gradient(spark, d):
    g = dense(spark, d).groupBy("site", "feature").agg(F.sum("count").alias("c")).withColumn("grad", F.col("site") % 7)
    return st.spearman(g, "c", "grad", ["feature"]).select("feature", F.round("rho", 6).alias("rho"))


@query("""WITH r AS (SELECT l_returnflag, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS y, l_discount - avg(l_discount) OVER (PARTITION BY l_returnflag) AS x1, l_tax - avg(l_tax) OVER (PARTITION BY l_returnflag) AS x2 FROM lineitem),
  s AS (SELECT 'discount' AS exposure, sum(x1 * y) AS xy, sum(x1 * x1) AS xx, sum(y * y) AS yy, count(*) AS n FROM r UNION ALL SELECT 'tax', sum(x2 * y), sum(x2 * x2), sum(y * y), count(*) FROM r)
  SELECT exposure, round(xy / xx, 6) AS beta, round(sqrt((yy - xy * xy / xx) / (n - 4) / xx), 6) AS se, round(xy * xy / xx / yy, 9) AS partial_r2 FROM s""")
def ss_7_8_scan_statistics(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    by = ["l_returnflag"]
    r = li.select(*[win.centred(c, by).alias(c) for c in ("l_quantity", "discount", "tax")])
    long = r.unpivot("l_quantity", ["discount", "tax"], "exposure", "x")
    y, x = F.col("l_quantity"), F.col("x")
    s = long.groupBy("exposure").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.count("*").alias("n"))
    fit = F.col("xy") * F.col("xy") / F.col("xx")
    return s.select(
        "exposure",
        F.round(F.col("xy") / F.col("xx"), 6).alias("beta"),
        F.round(F.sqrt((F.col("yy") - fit) / (F.col("n") - 4) / F.col("xx")), 6).alias("se"),
        F.round(fit / F.col("yy"), 9).alias("partial_r2"),
    )


#: each term's residual on the others gives its coefficient and its part of the sandwich
@query("""WITH d AS (SELECT l_suppkey AS g, l_discount AS a, l_tax AS b, l_quantity AS y FROM lineitem), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb,
    sum(a * a) AS qaa, sum(b * b) AS qbb, sum(a * b) AS qab, sum(a) AS ta, sum(b) AS tb, count(*) AS n, count(DISTINCT g) AS groups FROM d),
  f AS (SELECT *, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS ba, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS bt FROM m), e AS (SELECT d.*, f.*, y - my - ba * (a - ma) - bt * (b - mb) AS e FROM d, f),
  r AS (SELECT g, n, groups, e, 'intercept' AS term, my - ba * ma - bt * mb AS beta, 1 - (qbb * ta - qab * tb) / (qaa * qbb - qab * qab) * a - (qaa * tb - qab * ta) / (qaa * qbb - qab * qab) * b AS r FROM e
    UNION ALL SELECT g, n, groups, e, 'l_discount', ba, (a - ma) - ab / bb * (b - mb) FROM e UNION ALL SELECT g, n, groups, e, 'l_tax', bt, (b - mb) - ab / aa * (a - ma) FROM e),
  c AS (SELECT term, any_value(beta) AS beta, any_value(n) AS n, any_value(groups) AS groups, g, sum(r * e) AS u, sum(r * r) AS rr FROM r GROUP BY term, g)
  SELECT term, round(any_value(beta), 6) AS beta, round(sqrt(sum(u * u) * any_value(groups) / (any_value(groups) - 1) * (any_value(n) - 1) / (any_value(n) - 3)) / sum(rr), 6) AS se FROM c GROUP BY term""")
def ss_6_ols_cluster_robust(spark, d):
    fit = st.ols(table(spark, d, "lineitem"), "l_quantity", ["l_discount", "l_tax"], cluster="l_suppkey")
    rows = [(t, float(b), float(s)) for t, b, s in zip(["intercept", "l_discount", "l_tax"], fit["beta"], fit["se"])]
    return spark.createDataFrame(rows, "term string, beta double, se double").select("term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"))


@query("SELECT round(regr_intercept(l_quantity, l_discount), 6) AS intercept, round(regr_slope(l_quantity, l_discount), 6) AS slope FROM lineitem")
def ss_6_ols_one_regressor(spark, d):
    fit = st.ols(table(spark, d, "lineitem"), "l_quantity", ["l_discount"])
    a, b = (F.round(F.lit(float(x)), 6) for x in fit["beta"])
    return spark.range(1).select(a.alias("intercept"), b.alias("slope"))


_COORD = "c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS axis FROM embeddings)"


def _coord(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("axis", "x")).withColumn("v", F.col("x").cast("double"))


@query(f"""WITH {_COORD}, w AS (SELECT *, avg(v) OVER (PARTITION BY label, axis) AS g, avg(v) OVER (PARTITION BY axis) AS m FROM c), s AS (SELECT sum((g - m) ** 2) AS ssb, sum((v - g) ** 2) AS ssw, count(DISTINCT label) AS k, count(DISTINCT vec_id) AS n FROM w)
  SELECT k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS pseudo_f FROM s""")
def ss_14_permanova(spark, d):
    return st.permanova(_coord(spark, d), "vec_id", "label", "axis", "v").select("k", "n", F.round("pseudo_f", 6).alias("pseudo_f"))


@query(f"""WITH {_COORD}, w AS (SELECT vec_id, label, sqrt(sum((v - g) ** 2)) AS dist FROM (SELECT *, avg(v) OVER (PARTITION BY label, axis) AS g FROM c) GROUP BY ALL) SELECT label, count(*) AS n, round(avg(dist), 6) AS dispersion FROM w GROUP BY label""")
def ss_15_dispersion(spark, d):
    c = _coord(spark, d).withColumn("r", win.centred("v", ["label", "axis"]))
    w = c.groupBy("vec_id", "label").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("dist"))
    return w.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("dispersion"))


@query(f"""WITH {_KNN}, e AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM near UNION ALL SELECT j, i FROM near)), z AS (SELECT site, x * y - avg(x * y) OVER () AS z FROM points)
  SELECT round((SELECT count(*) FROM z) / count(*) * sum(a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS moran_i FROM e JOIN z a ON a.site = e.i JOIN z b ON b.site = e.j""")
def ss_16_moran(spark, d):
    p = points(spark, d)
    e = rel.symmetric_edges(rel.nearest(p, "site", "x", "y", 5))
    return st.moran(p.withColumn("v", F.col("x") * F.col("y")), e, "site", "v").select(F.round("moran_i", 6).alias("moran_i"))


_MANTEL = """p AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 11)::DOUBLE AS a, (n_nationkey * 5 % 13)::DOUBLE AS b FROM nation),
 q AS (SELECT x.k AS i, y.k AS j, abs(x.a - y.a) AS da, abs(x.b - y.b) AS db FROM p x JOIN p y ON x.k < y.k)"""


def _mantel(spark, d):
    k = F.col("n_nationkey")
    p = table(spark, d, "nation").select(k.alias("k"), (k * 7 % 11).cast("double").alias("a"), (k * 5 % 13).cast("double").alias("b"))
    return p, rel.pairs(p, "k", cols=["a", "b"])


@query(f"WITH {_MANTEL} SELECT round(corr(da, db), 6) AS r FROM q")
def ss_17_mantel(spark, d):
    _, q = _mantel(spark, d)
    return q.agg(F.round(F.corr(F.abs(F.col("a_i") - F.col("a_j")), F.abs(F.col("b_i") - F.col("b_j"))), 6).alias("r"))


@query(f"""WITH {_MANTEL}, e AS (SELECT list_distinct(quantile_cont(da, [0.25, 0.5, 0.75])) AS edges FROM q) SELECT class, count(*) AS n, round(avg(db), 6) AS mean_db FROM (SELECT len(list_filter(edges, lambda x: da >= x)) AS class, db FROM q, e) GROUP BY class""")
def ss_18_correlogram(spark, d):
    _, q = _mantel(spark, d)
    q = q.select(F.abs(F.col("a_i") - F.col("a_j")).alias("da"), F.abs(F.col("b_i") - F.col("b_j")).alias("db"))
    c = q.crossJoin(F.broadcast(win.quantile_edges(q, "da", 4))).withColumn("class", win.digitise(F.col("da"), F.col("edges")).cast("long"))
    return c.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("db"), 6).alias("mean_db"))


_PAIRED = f"{SQL_SITES}, w AS (SELECT site, feature, max(count) FILTER (WHERE position = 'A') AS a, max(count) FILTER (WHERE position = 'R') AS r FROM sites GROUP BY ALL), diffs AS (SELECT site, feature, a - r AS diff FROM w WHERE a IS NOT NULL AND r IS NOT NULL)"


def _paired(spark, d):
    w = sites(spark, d).groupBy("site", "feature").pivot("position", ["A", "R"]).agg(F.max("count")).dropna(subset=["A", "R"])
    return w.select("site", "feature", (F.col("A") - F.col("R")).alias("diff"))


@query(f"""WITH {_PAIRED}, r AS (SELECT site, diff, {_RANK.format(by="site", x="abs(diff)")} AS r FROM diffs WHERE diff <> 0)
  SELECT site, count(*) AS n, coalesce(sum(r) FILTER (WHERE diff > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE diff < 0), 0)::DOUBLE AS w_minus, least(coalesce(sum(r) FILTER (WHERE diff > 0), 0), coalesce(sum(r) FILTER (WHERE diff < 0), 0))::DOUBLE AS w FROM r GROUP BY site""")
def ss_19_wilcoxon(spark, d):
    return st.wilcoxon_w(_paired(spark, d), "diff", ["site"])


@query(f"WITH {_PAIRED} SELECT site, count(*) AS n, round(avg(diff), 6) AS mean, median(diff::DOUBLE) AS median, round(avg((diff > 0)::INT), 6) AS positive FROM diffs GROUP BY site")
def ss_25_paired_contrasts(spark, d):
    return _paired(spark, d).groupBy("site").agg(
        F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean"), F.median("diff").alias("median"), F.round(F.avg((F.col("diff") > 0).cast("int")), 6).alias("positive")
    )


@query(f"""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), t AS (SELECT q, n_chars AS v FROM documents JOIN l USING (doc_id)), r AS (SELECT 1 AS g, q, v FROM t), k AS (SELECT q, {_RANK.format(by="g", x="v")} AS r FROM r),
  u AS (SELECT count(*) FILTER (WHERE q = 1) AS n1, count(*) FILTER (WHERE q <> 1) AS n2, sum(r) FILTER (WHERE q = 1) - count(*) FILTER (WHERE q = 1) * (count(*) FILTER (WHERE q = 1) + 1) / 2 AS u FROM k)
  SELECT n1, n2, u::DOUBLE AS u, round(2 * u / (n1 * n2) - 1, 6) AS cliffs_delta FROM u""")
def ss_20_39_mann_whitney(spark, d):
    q = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    t = table(spark, d, "documents").join(q, "doc_id").select("q", F.col("n_chars").alias("v"))
    return st.mann_whitney(t, "q", "v", 1).withColumn("cliffs_delta", F.round("cliffs_delta", 6))


@query(f"""WITH {SQL_SITES}, c AS (SELECT site, position, sum(count) AS v FROM sites GROUP BY ALL), f AS (SELECT * FROM c WHERE site IN (SELECT site FROM c GROUP BY site HAVING count(*) = 3)),
  r AS (SELECT position, {_RANK.format(by="site", x="v")} AS r FROM f), s AS (SELECT position, sum(r) AS r, count(*) AS n FROM r GROUP BY position)
  SELECT count(*) AS k, max(n) AS n, round(12 / (max(n) * count(*) * (count(*) + 1)) * sum(r * r) - 3 * max(n) * (count(*) + 1), 6) AS chi2 FROM s""")
def ss_21_friedman(spark, d):
    c = sites(spark, d).groupBy("site", "position").agg(F.sum("count").alias("v"))
    return st.friedman(rel.complete_blocks(c, ["site"], "position", 3), "site", "position", "v").withColumn("chi2", F.round("chi2", 6))


_SCREEN = f"""{SQL_LINES}, prof AS (SELECT profile, feature, bool_or(campaign % 3 = 0) AS blank_hit, bool_or(campaign % 3 <> 0) AS sample_hit FROM lines GROUP BY ALL),
 tot AS (SELECT count(DISTINCT profile) AS n FROM lines), tab AS (SELECT feature, count(*) FILTER (WHERE blank_hit) AS a, max(n) - count(*) FILTER (WHERE blank_hit) AS b, count(*) FILTER (WHERE sample_hit AND profile % 4 = 0) AS c, max(n) - count(*) FILTER (WHERE sample_hit AND profile % 4 = 0) AS d FROM prof, tot GROUP BY feature)"""
_LC = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
_TAIL = (
    "CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE least(1, (SELECT sum(exp("
    + _LC.format(n="(a + b)", k="x")
    + " + "
    + _LC.format(n="(c + d)", k="(a + c - x)")
    + " - ("
    + _LC.format(n="(a + b + c + d)", k="(a + c)")
    + "))) FROM (SELECT unnest(generate_series(greatest(a, a + c - (c + d)), least(a + b, a + c))) AS x))) END"
)


def _screen(spark, d):
    li = lines(spark, d)
    prof = li.groupBy("profile", "feature").agg(F.bool_or(F.col("campaign") % 3 == 0).alias("blank"), F.bool_or(F.col("campaign") % 3 != 0).alias("sample"))
    n = li.agg(F.countDistinct("profile").alias("n"))
    a, c = F.count_if(F.col("blank")), F.count_if(F.col("sample") & (F.col("profile") % 4 == 0))
    t = prof.crossJoin(F.broadcast(n)).groupBy("feature").agg(a.alias("a"), (F.max("n") - a).alias("b"), c.alias("c"), (F.max("n") - c).alias("d"))
    return t.withColumn("p", st.fisher_greater("a", "b", "c", "d"))


@query(f"WITH {_SCREEN} SELECT feature, a, b, c, d, round({_TAIL}, 6) AS p FROM tab")
def ss_22_fisher_exact(spark, d):
    return _screen(spark, d).withColumn("p", F.round("p", 6))


@query(f"""WITH {_SCREEN}, s AS (SELECT feature, a, a / (a + b) AS pa, c / (c + d) AS pc, round({_TAIL}, 6) AS p FROM tab), grid AS (SELECT t::DOUBLE AS t, m FROM (VALUES (0.01), (0.05), (0.1)) x(t), (VALUES (1), (2), (3)) y(m)),
  calls AS (SELECT t, m, feature FROM s, grid WHERE p < t AND a >= m AND pa > pc) SELECT t, m::BIGINT AS m, count(DISTINCT calls.feature) AS called, coalesce(round(sum(r.reads) / (SELECT sum(reads) FROM lines), 9), 0) AS removed
  FROM grid LEFT JOIN calls USING (t, m) LEFT JOIN (SELECT feature, sum(reads) AS reads FROM lines GROUP BY feature) r ON r.feature = calls.feature GROUP BY t, m""")
def ss_23_contaminant_grid(spark, d):
    s = _screen(spark, d).withColumn("p", F.round("p", 6))
    one = spark.range(1)
    grid = one.select(F.explode(F.array(*[F.lit(x) for x in (0.01, 0.05, 0.1)])).alias("t")).crossJoin(one.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("m")))
    more = F.col("a") / (F.col("a") + F.col("b")) > F.col("c") / (F.col("c") + F.col("d"))
    called = s.filter(more).join(F.broadcast(grid), (F.col("p") < F.col("t")) & (F.col("a") >= F.col("m"))).select("t", "m", "feature")
    reads = lines(spark, d).groupBy("feature").agg(F.sum("reads").alias("reads"))
    total = reads.agg(F.sum("reads").alias("total"))
    df = grid.join(called, ["t", "m"], "left").join(reads, "feature", "left").crossJoin(F.broadcast(total))
    return df.groupBy("t", F.col("m").cast("long").alias("m")).agg(
        F.countDistinct("feature").alias("called"), F.coalesce(F.round(F.sum("reads") / F.max("total"), 9), F.lit(0.0)).alias("removed")
    )


@query(f"""WITH {SQL_LINES}, src AS (SELECT DISTINCT feature, profile FROM lines WHERE kind LIKE 'S%' AND reads >= 45) SELECT src.profile AS source, count(DISTINCT l.profile) FILTER (WHERE l.position = 'N') AS negatives,
  count(DISTINCT l.profile) FILTER (WHERE l.position = 'R') AS biological, count(DISTINCT l.profile) FILTER (WHERE abs(l.profile - src.profile) <= 2) AS neighbours FROM src JOIN lines l ON l.feature = src.feature AND l.profile <> src.profile GROUP BY src.profile""")
def ss_24_spillover_trace(spark, d):
    """Profiles that share a feature with each source of high counts; they are counted by classes of equal feature sets, never paired one by one."""
    found = F.col("kind").like("S%") & (F.col("reads") >= 45)
    seen = lines(spark, d).groupBy("feature", "profile").agg(F.bool_or(F.col("position") == "N").alias("neg"), F.bool_or(F.col("position") == "R").alias("bio"), F.bool_or(found).alias("src"))
    seen = durable(seen.filter("feature IS NOT NULL AND profile IS NOT NULL"))
    src = seen.filter("src")
    others = lambda c, name: vectors.meeting(src, seen.filter(c), "profile", "feature").select(F.col("profile").alias(f"of_{name}"), F.col("n").alias(name))
    own = src.groupBy(F.col("profile").alias("source")).agg(F.bool_or(F.coalesce("neg", F.lit(False))).alias("own_neg"), F.bool_or(F.coalesce("bio", F.lit(False))).alias("own_bio"))
    near = src.select(F.col("feature").alias("f"), F.col("profile").alias("of_near"), F.explode(F.array(*[F.col("profile") + k for k in (-2, -1, 1, 2)])).alias("p"))
    near = near.join(seen, (F.col("f") == F.col("feature")) & (F.col("p") == F.col("profile"))).groupBy("of_near").agg(F.countDistinct("p").alias("neighbours"))
    for name, t in (("met", others("true", "met")), ("neg", others("neg", "neg")), ("bio", others("bio", "bio")), ("near", near)):
        own = own.join(t, F.col("source") == F.col(f"of_{name}"), "left")
    less = lambda n, mine: F.col(n) - F.col(mine).cast("long")
    return own.filter("met > 1").select("source", less("neg", "own_neg").alias("negatives"), less("bio", "own_bio").alias("biological"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


@query(f"""WITH {_DENSE}, l AS (SELECT *, ln(count + 0.5::DOUBLE) AS l FROM dense), c AS (SELECT site, position, feature, l - avg(l) OVER (PARTITION BY site, position) AS clr FROM l),
  b AS (SELECT *, clr - avg(clr) OVER (PARTITION BY site, feature) AS z FROM c WHERE site IN (SELECT site FROM c GROUP BY site HAVING count(DISTINCT position) = 3)), t AS (SELECT position, feature, avg(z) AS m FROM b GROUP BY ALL)
  SELECT round(sqrt(sum((a.m - r.m) ** 2)), 6) AS displacement FROM t a JOIN t r ON a.feature = r.feature AND a.position = 'A' AND r.position = 'R'""")
def ss_26_27_paired_displacement(spark, d):
    from varve.operators.compose import clr

    c = clr(dense(spark, d), ["site", "position"], "count")
    c = rel.complete_blocks(c, ["site"], "position", 3).withColumn("z", win.centred("clr", ["site", "feature"]))
    t = c.groupBy("feature").pivot("position", ["A", "R"]).agg(F.avg("z"))
    return t.agg(F.round(F.sqrt(F.sum(F.pow(F.col("A") - F.col("R"), 2))), 6).alias("displacement"))


@query("""WITH v AS (SELECT (sum(s_acctbal) OVER () - s_acctbal) / (count(*) OVER () - 1) AS t FROM supplier) SELECT count(*) AS n, round(sqrt((count(*) - 1) * var_pop(t)), 6) AS se FROM v""")
def ss_28_jackknife(spark, d):
    v = win.leave_one_out(table(spark, d, "supplier"), "s_acctbal", "t")
    return v.agg(F.count("*").alias("n"), F.round(st.jackknife_se("t"), 6).alias("se"))


@query(f"""WITH {SQL_COUNTS}, t AS (SELECT campaign, site, ln(sum(count)) AS y, site % 5 AS x, site % 4 AS block FROM counts GROUP BY campaign, site),
  f AS (SELECT g.b, g.c, t.* FROM (SELECT DISTINCT block AS b FROM t) CROSS JOIN (SELECT DISTINCT campaign AS c FROM t) g, t), m AS (SELECT b, c, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(y) AS base FROM f WHERE block <> b AND campaign <> c GROUP BY b, c)
  SELECT m.b, m.c, count(*) AS n, round(1 - sum((y - i - s * x) ** 2) / sum((y - base) ** 2), 6) AS skill FROM m JOIN t ON t.block = m.b AND t.campaign = m.c GROUP BY m.b, m.c""".replace("SELECT g.b, g.c, t.*", "SELECT b, c, t.*"))
def ss_29_held_out_skill(spark, d):
    t = counts(spark, d).groupBy("campaign", "site").agg(F.log(F.sum("count")).alias("y"))
    t = t.withColumns({"x": F.col("site") % 5, "block": F.col("site") % 4})
    folds = t.select(F.col("block").alias("b")).distinct().crossJoin(t.select(F.col("campaign").alias("c")).distinct())
    train = t.join(F.broadcast(folds), (F.col("block") != F.col("b")) & (F.col("campaign") != F.col("c")))
    m = train.groupBy("b", "c").agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.avg("y").alias("base"))
    test = t.join(F.broadcast(m), (F.col("block") == F.col("b")) & (F.col("campaign") == F.col("c")))
    sse = F.sum(F.pow(F.col("y") - F.col("i") - F.col("s") * F.col("x"), 2))
    return test.groupBy("b", "c").agg(F.count("*").alias("n"), F.round(1 - sse / F.sum(F.pow(F.col("y") - F.col("base"), 2)), 6).alias("skill"))


_EDGES = "edges AS (SELECT s_suppkey AS i, s_suppkey % 7 AS j, (s_suppkey * 37 % 100) / 100.0::DOUBLE AS stability, (s_suppkey * 13 % 10) / 10.0::DOUBLE AS sign_share, (s_suppkey * 7 % 20) / 100.0::DOUBLE AS null_share, s_suppkey % 3 AS network FROM supplier)"


@query(f"WITH {_EDGES} SELECT network, count(*) AS edges, count(*) FILTER (WHERE stability >= 0.4 AND sign_share >= 0.3 AND null_share <= 0.15) AS stable, round(avg((sign_share > 0.5)::INT), 6) AS positive, median(stability) AS median_stability FROM edges GROUP BY network")
def ss_33_cx_17_stable_edges(spark, d):
    k = F.col("s_suppkey")
    e = table(spark, d, "supplier").select((k * 37 % 100 / 100.0).alias("stability"), (k * 13 % 10 / 10.0).alias("sign_share"), (k * 7 % 20 / 100.0).alias("null_share"), (k % 3).alias("network"))
    keep = (F.col("stability") >= 0.4) & (F.col("sign_share") >= 0.3) & (F.col("null_share") <= 0.15)
    return e.groupBy("network").agg(F.count("*").alias("edges"), F.count_if(keep).alias("stable"), F.round(F.avg((F.col("sign_share") > 0.5).cast("int")), 6).alias("positive"), F.median("stability").alias("median_stability"))


@query(f"""WITH {_SITE}, a AS (SELECT DISTINCT p_brand AS feature, p_type AS trait FROM part), f AS (SELECT site, trait AS feature, sum(count) AS count FROM m JOIN a USING (feature) GROUP BY ALL),
  b AS (SELECT 'taxonomic' AS level, * FROM m UNION ALL SELECT 'functional', * FROM f), t AS (SELECT level, site, sum(count) AS n FROM b GROUP BY ALL), s AS (SELECT x.level, x.site AS i, y.site AS j, sum(least(x.count, y.count)) AS s FROM b x JOIN b y ON x.level = y.level AND x.feature = y.feature AND x.site < y.site GROUP BY ALL),
  d AS (SELECT x.level, 1 - 2 * coalesce(s, 0) / (x.n + y.n) AS bray FROM t x JOIN t y ON x.level = y.level AND x.site < y.site LEFT JOIN s ON s.level = x.level AND s.i = x.site AND s.j = y.site)
  SELECT round(median(bray::DOUBLE) FILTER (WHERE level = 'functional') / median(bray::DOUBLE) FILTER (WHERE level = 'taxonomic'), 6) AS ratio FROM d""")
def ss_36_redundancy_ratio(spark, d):
    from varve.operators.compose import bray_curtis

    m = _site(spark, d)
    ann = table(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_type").alias("trait")).distinct()
    f = m.join(ann, "feature").groupBy("site", F.col("trait").alias("feature")).agg(F.sum("count").alias("count"))
    mid = lambda df: bray_curtis(df, "site", "feature", "count").agg(F.median("bray").alias("m"))
    return mid(f).withColumnRenamed("m", "fm").crossJoin(mid(m)).select(F.round(F.col("fm") / F.col("m"), 6).alias("ratio"))


@query(f"""WITH {_SITE}, h AS (SELECT site, feature, count + length(feature) * site % 50 AS other, count FROM m), r AS (SELECT site, {_RANK.format(by="site", x="count")} AS x, {_RANK.format(by="site", x="other")} AS y FROM h) SELECT site, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY site HAVING count(*) >= 3""")
def ss_37_profile_concordance(spark, d):
    h = _site(spark, d).withColumn("other", F.col("count") + F.length("feature") * F.col("site") % 50)
    return st.spearman(h, "count", "other", ["site"]).filter("n >= 3").select("site", "n", F.round("rho", 6).alias("rho"))


# --- resampling ------------------------------------------------------------------


_H = "('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT"
#: units are customers, in strata by nation
_UNITS = "units AS (SELECT c_custkey AS unit, c_acctbal - 4400::DOUBLE AS v, c_nationkey AS region FROM customer)"


def _units(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_acctbal") - 4400.0).alias("v"), F.col("c_nationkey").alias("region"))


@query(f"""WITH {_UNITS}, r AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS i, v FROM units), n AS (SELECT count(*) AS n FROM units), p AS (SELECT draw, {_H.format("'11', draw, i")} % n AS i FROM r, range(0, 99) d(draw), n),
  b AS (SELECT draw, avg(v) AS m FROM p JOIN r USING (i) GROUP BY draw) SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b""")
def rm_1_bootstrap_mean(spark, d):
    b = rs.bootstrap_means(_units(spark, d), "unit", "v", 99, 11)
    p = lambda q: F.round(F.percentile("mean", F.lit(q)), 6)
    return b.agg(F.round(F.avg("mean"), 6).alias("mean"), p(0.025).alias("low"), p(0.975).alias("high"))


@query(f"""WITH {_UNITS}, b AS (SELECT region, sum(v) AS s, count(*) AS c FROM units GROUP BY region), r AS (SELECT row_number() OVER (ORDER BY region) - 1 AS i, s, c FROM b), n AS (SELECT count(*) AS n FROM b),
  p AS (SELECT draw, {_H.format("'12', draw, i")} % n AS i FROM r, range(0, 99) d(draw), n) SELECT draw, round(sum(s), 4) AS s, sum(c)::BIGINT AS c FROM p JOIN r USING (i) GROUP BY draw""")
def rm_2_block_bootstrap(spark, d):
    b = _units(spark, d).groupBy("region").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    return rs.block_bootstrap(b, "region", ["s", "c"], 99, 12).withColumn("s", F.round("s", 4))


@query(f"""WITH p AS (SELECT draw, value, {' + '.join(f"(u >= {c!r}::DOUBLE)::INT" for c in rs.POISSON)} AS m FROM (SELECT draw, value, {_H.format("'18', draw, event_id")} / 4294967296::DOUBLE AS u FROM events, range(0, 20) d(draw)))
  SELECT draw, round(sum(m * value) / sum(m), 6) AS mean FROM p GROUP BY draw""")
def rm_1_poisson_bootstrap(spark, d):
    return rs.poisson_means(table(spark, d, "events"), "event_id", "value", 20, 18).select("draw", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_UNITS}, f AS (SELECT draw, avg(CASE WHEN {_H.format("'13', draw, unit")} % 2 = 0 THEN v ELSE -v END) AS m FROM units, range(0, 99) d(draw) GROUP BY draw), o AS (SELECT abs(avg(v)) AS o FROM units)
  SELECT round(o, 6) AS observed, round((1 + count(*) FILTER (WHERE abs(m) >= o - 1e-12)) / (1 + count(*)), 6) AS p FROM f, o GROUP BY o""")
def rm_4_10_sign_flip(spark, d):
    u = _units(spark, d)
    null = rs.sign_flips(u, "unit", "v", 99, 13).withColumn("mean", F.abs("mean"))
    p = rs.plus_one_p(null, "mean", u.agg(F.abs(F.avg("v")).alias("observed")))
    return p.select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


def _perm_sql(seed: int, by: str) -> str:
    part = f"PARTITION BY {by}draw"
    keys = f"{by}draw"
    return f"""many AS (SELECT draw, units.* FROM units, range(0, 20) d(draw)), a AS (SELECT {keys}, unit, row_number() OVER ({part} ORDER BY unit) AS n FROM many),
  b AS (SELECT {keys}, v, row_number() OVER ({part} ORDER BY {_H.format(f"'{seed}', draw, unit")}, unit) AS n FROM many)"""


@query(f"WITH {_UNITS}, {_perm_sql(14, 'region, ')} SELECT region, draw, unit, v FROM a JOIN b USING (region, draw, n)")
def rm_5_permuted_within(spark, d):
    return rs.permuted(_units(spark, d), "unit", "v", 20, 14, ["region"])


@query(f"WITH {_UNITS}, {_perm_sql(15, '')} SELECT draw, unit, v FROM a JOIN b USING (draw, n)")
def rm_6_permuted(spark, d):
    return rs.permuted(_units(spark, d), "unit", "v", 20, 15)


@query(f"""WITH {_MANTEL}, many AS (SELECT draw, p.* FROM p, range(0, 19) d(draw)), x AS (SELECT draw, k, row_number() OVER (PARTITION BY draw ORDER BY k) AS n FROM many), y AS (SELECT draw, b, row_number() OVER (PARTITION BY draw ORDER BY {_H.format("'16', draw, k")}, k) AS n FROM many),
  s AS (SELECT draw, k, b FROM x JOIN y USING (draw, n)), r AS (SELECT s.draw, corr(da, abs(s.b - t.b)) AS r FROM q JOIN s ON s.k = q.i JOIN s t ON t.k = q.j AND t.draw = s.draw GROUP BY s.draw) SELECT draw, round(r, 6) AS r FROM r""")
def rm_6_ss_17_mantel_null(spark, d):
    p, q = _mantel(spark, d)
    s = rs.permuted(p.select("k", "b"), "k", "b", 19, 16)
    i = s.select("draw", F.col("k").alias("k_i"), F.col("b").alias("bi"))
    j = s.select(F.col("draw").alias("e"), F.col("k").alias("kj"), F.col("b").alias("bj"))
    df = q.select("k_i", "k_j", F.abs(F.col("a_i") - F.col("a_j")).alias("da")).join(i, "k_i").join(j, (F.col("k_j") == F.col("kj")) & (F.col("draw") == F.col("e")))
    return df.groupBy("draw").agg(F.round(F.corr("da", F.abs(F.col("bi") - F.col("bj"))), 6).alias("r"))


@query(f"""WITH c AS (SELECT conv_id, turn, length(text) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), m AS (SELECT draw, c.* FROM c, range(0, 3) d(draw)),
  s AS (SELECT conv_id, draw, v, (p + {_H.format("'17', draw, conv_id")}) % n AS p FROM m) SELECT m.conv_id, m.draw, m.turn, s.v FROM m JOIN s ON s.conv_id = m.conv_id AND s.draw = m.draw AND s.p = m.p""")
def rm_7_circular_shift(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("v"))
    return rs.circular_shift(c, ["conv_id"], "turn", "v", 3, 17)


#: monthly orders and revenue of each nation; the null shifts each nation's revenue by its own draw
_MONTHS = """raw AS (SELECT c_nationkey AS g, year(o_orderdate) * 12 + month(o_orderdate) AS t, count(*)::DOUBLE AS y, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 s AS (SELECT g, t - (SELECT min(t) FROM raw) AS t, y, x FROM raw), size AS (SELECT max(t) + 1 AS n FROM s)"""


@query(f"""WITH {_MONTHS}, o AS (SELECT lag, corr(a.y, b.x) AS r FROM s a JOIN range(0, 4) l(lag) ON true JOIN size ON true JOIN s b ON b.g = a.g AND b.t = (a.t + lag) % n GROUP BY lag),
  k AS (SELECT draw, lag, corr(a.y, b.x) AS r FROM s a JOIN range(0, 4) l(lag) ON true JOIN range(0, 19) e(draw) ON true JOIN size ON true JOIN s b ON b.g = a.g AND b.t = (a.t + lag + {_H.format("'19', draw, a.g")}) % n GROUP BY draw, lag),
  m AS (SELECT draw, max(abs(r)) AS top FROM k GROUP BY draw) SELECT lag, round(r, 6) AS r, round((1 + (SELECT count(*) FROM m WHERE top >= abs(r) - 1e-12)) / (1 + (SELECT count(*) FROM m)), 6) AS p FROM o""")
def rm_8_shift_max_statistic(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = o.groupBy(F.col("c_nationkey").alias("g"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.count("*").cast("double").alias("y"), F.sum("o_totalprice").alias("x"))
    span = raw.agg(F.min("t").alias("low"), (F.max("t") - F.min("t") + 1).alias("n"))
    s = raw.crossJoin(F.broadcast(span)).withColumn("t", F.col("t") - F.col("low"))
    b = s.select(F.col("g").alias("h"), F.col("t").alias("to"), F.col("x").alias("w"))
    lags = spark.range(4).select(F.col("id").alias("lag"))
    # draw -1 is the data, the others move every nation's series by the nation's own shift
    many = s.crossJoin(F.broadcast(lags.crossJoin(spark.range(-1, 19).select(F.col("id").alias("draw")))))
    shift = F.when(F.col("draw") < 0, 0).otherwise(rs.hash_draw(19, "draw", "g"))
    a = many.withColumn("at", ((F.col("t") + F.col("lag") + shift) % F.col("n")).cast("int"))
    r = a.join(b, (F.col("g") == F.col("h")) & (F.col("at") == F.col("to"))).groupBy("draw", "lag").agg(F.corr("y", "w").alias("r"))
    top = r.filter("draw >= 0").groupBy("draw").agg(F.max(F.abs("r")).alias("top"))
    seen = r.filter("draw < 0").select("lag", "r")
    hits = F.count_if(F.col("top") >= F.abs("r") - 1e-12)
    p = seen.crossJoin(F.broadcast(top)).groupBy("lag", "r").agg(((1 + hits) / (1 + F.count(F.lit(1)))).alias("p"))
    return p.select("lag", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@query("""WITH o AS (SELECT month(o_orderdate) - 1 AS pos, count(*) AS v FROM orders GROUP BY 1), s AS (SELECT turn, shift, sum(v * ((turn * pos + shift + 12) % 12)) AS stat FROM o, range(0, 12) r(shift), (VALUES (1), (-1)) t(turn) GROUP BY turn, shift)
  SELECT turn::BIGINT AS turn, shift, round((SELECT avg((b.stat >= a.stat - 1e-12)::INT) FROM s b), 9) AS p FROM s a""")
def rm_9_orbit_null(spark, d):
    """All shifts and reflections of the calendar: the orbit is listed whole, so nothing is drawn."""
    o = table(spark, d, "orders").groupBy((F.month("o_orderdate") - 1).alias("pos")).agg(F.count("*").alias("v"))
    orbit = spark.range(12).select(F.col("id").alias("shift"), F.explode(F.array(F.lit(1).cast("long"), F.lit(-1).cast("long"))).alias("turn"))
    s = o.crossJoin(F.broadcast(orbit)).groupBy("turn", "shift").agg(F.sum(F.col("v") * ((F.col("turn") * F.col("pos") + F.col("shift") + 12) % 12)).alias("stat"))
    null = s.select(F.col("stat").alias("null"))
    return s.crossJoin(F.broadcast(null)).groupBy("turn", "shift").agg(F.round(F.avg((F.col("null") >= F.col("stat") - 1e-12).cast("int")), 9).alias("p"))


@query(f"WITH {SQL_SITES} SELECT o.site AS omitted, round(avg(s.count), 6) AS mean FROM (SELECT DISTINCT site FROM sites) o JOIN sites s ON s.site <> o.site GROUP BY o.site")
def rm_12_leave_one_group_out(spark, d):
    s = sites(spark, d).groupBy("site").agg(F.sum("count").alias("t"), F.count("*").alias("n"))
    whole = s.agg(F.sum("t").alias("wt"), F.sum("n").alias("wn"))
    return s.crossJoin(F.broadcast(whole)).select(F.col("site").alias("omitted"), F.round((F.col("wt") - F.col("t")) / (F.col("wn") - F.col("n")), 6).alias("mean"))


@query(f"WITH {_KNN} SELECT CASE WHEN x <= (SELECT median(x) FROM points) THEN 'west' ELSE 'east' END AS half, count(*) AS n, round(avg(y), 6) AS mean_y FROM points GROUP BY 1")
def rm_13_spatial_halves(spark, d):
    p = points(spark, d)
    mid = p.agg(F.median("x").alias("m"))
    df = p.crossJoin(F.broadcast(mid)).withColumn("half", F.when(F.col("x") <= F.col("m"), "west").otherwise("east"))
    return df.groupBy("half").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))
