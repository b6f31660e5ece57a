"""Models, ordination, networks, file formats and streaming forms over the fixture tables."""

from __future__ import annotations

import io
import tarfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.operators import linear as li
from varve.operators import stats as st
from varve.operators import windows as win
from varve.plans.base import SQL_LINES, SQL_SITES, lines, sites
from varve.plans.diversity import _DENSE, dense
from varve.plans.relational import points
from varve.session import shared_folder, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _row(spark, **values):
    """One row of rounded numbers and labels."""
    return spark.range(1).select(*[(F.lit(round(v, 6) + 0.0) if isinstance(v, float) else F.lit(v)).alias(k) for k, v in values.items()])


_R = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@query(f"""WITH r AS (SELECT {_R.format("c_acctbal")} AS x, {_R.format("c_nationkey")} AS y, {_R.format("c_custkey")} AS z FROM customer), c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM r)
  SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r, n FROM c""")
def ss_3_partial_spearman(spark, d):
    fit = li.partial_spearman(table(spark, d, "customer"), "c_acctbal", "c_nationkey", ["c_custkey"])
    return _row(spark, r=fit["r"]).withColumn("n", F.lit(int(fit["n"])).cast("long"))


#: centred columns made orthogonal one by one give sums of squares; coefficients are put back from the last to the first
@query("""WITH c AS (SELECT l_extendedprice - avg(l_extendedprice) OVER () AS y, l_quantity - avg(l_quantity) OVER () AS a, l_discount - avg(l_discount) OVER () AS b, l_tax - avg(l_tax) OVER () AS c FROM lineitem), g AS (SELECT sum(a * b) / sum(a * a) AS ba, sum(a * c) / sum(a * a) AS ca FROM c),
  p AS (SELECT y, a, b - ba * a AS b, c - ca * a AS c, ba, ca FROM c, g), h AS (SELECT sum(b * c) / sum(b * b) AS cb FROM p), q AS (SELECT y, a, b, c - cb * b AS c, ba, ca, cb FROM p, h),
  s AS (SELECT count(*) AS n, sum(y * y) AS yy, sum(a * y) / sum(a * a) AS fa, sum(b * y) / sum(b * b) AS fb, sum(c * y) / sum(c * c) AS fc, sum(a * y) ** 2 / sum(a * a) + sum(b * y) ** 2 / sum(b * b) + sum(c * y) ** 2 / sum(c * c) AS fit, any_value(ba) AS ba, any_value(ca) AS ca, any_value(cb) AS cb FROM q)
  SELECT round(fit / 3 / ((yy - fit) / (n - 4)), 3) AS f, round(fa - fc * ca - (fb - fc * cb) * ba, 4) AS quantity, round(fb - fc * cb, 4) AS discount, round(fc, 4) AS tax, true AS valid FROM s""")
def ss_9_joint_regression(spark, d):
    fit = li.joint_regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    at = lambda v, n, name: F.round(F.lit(float(v)), n).alias(name)
    return spark.range(1).select(at(fit["f"], 3, "f"), *[at(fit["beta"][i + 1], 4, name) for i, name in enumerate(("quantity", "discount", "tax"))], F.lit(bool(fit["valid"])).alias("valid"))


def _gee_sql(rounds: int = 8) -> str:
    """Rounds of the estimating equations, each three one-row tables over the clusters' sums (0 to 2 are regressors, 3 is the outcome)."""
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    x = ("1.0", "r", "n", "y")
    sums = ", ".join([f"sum({x[i]} * {x[j]}) AS g{i}{j}" for i in range(4) for j in range(i, 4)] + [f"sum({x[i]}) AS s{i}" for i in range(4)])
    parts = [f"""d AS (SELECT l_suppkey AS k, l_quantity AS y, (l_returnflag = 'R')::DOUBLE AS r, (l_returnflag = 'N')::DOUBLE AS n FROM lineitem), per AS (SELECT k, count(*) AS size, {sums} FROM d GROUP BY k), k0 AS (SELECT 0.0::DOUBLE AS rho)"""]
    cof = lambda i, j: f"({_cofactor(i, j)})"
    for t in range(1, rounds + 1):
        m = ", ".join(f"sum((g{i}{j} - sh * s{i} * s{j}) / (1 - rho)) AS m{i}{j}" for i in range(4) for j in range(i, 4))
        parts.append(f"m{t} AS (SELECT {m} FROM (SELECT per.*, rho, rho / (1 + (size - 1) * rho) AS sh FROM per, k{t - 1}))")
        inverse = ", ".join(f"{cof(i, j)} / (m00 * {cof(0, 0)} + m01 * {cof(0, 1)} + m02 * {cof(0, 2)}) AS i{i}{j}" for i in range(3) for j in range(i, 3))
        parts.append(f"i{t} AS (SELECT *, {inverse} FROM m{t})")
        beta = ", ".join(f"{' + '.join(f'i{min(i, j)}{max(i, j)} * m{j}3' for j in range(3))} AS b{i}" for i in range(3))
        parts.append(f"b{t} AS (SELECT *, {beta} FROM i{t})")
        v = ["-b0", "-b1", "-b2", "1"]
        rss = " + ".join(f"({v[i]}) * ({v[j]}) * {g(i, j)}" for i in range(4) for j in range(4))
        tot = " + ".join(f"({v[i]}) * s{i}" for i in range(4))
        parts.append(f"r{t} AS (SELECT sum(rss) AS ss, sum((tot * tot - rss) / 2) AS crossed, sum(size * (size - 1) / 2) AS pairs, sum(size) AS n FROM (SELECT size, {rss} AS rss, {tot} AS tot FROM per, b{t}))")
        parts.append(f"k{t} AS (SELECT least(0.99, greatest(-0.99, crossed / greatest(pairs - 3, 1) / (ss / (n - 3))))::DOUBLE AS rho FROM r{t})")
    u = ", ".join(f"({' + '.join(f'({v[j]}) * ({g(i, j)} - sh * s{i} * s{j})' for j in range(4))}) / (1 - rho) AS u{i}" for i in range(3))
    parts.append(f"u AS (SELECT {u} FROM (SELECT per.*, b{rounds}.*, rho, rho / (1 + (size - 1) * rho) AS sh FROM per, b{rounds}, k{rounds}))")
    parts.append("q AS (SELECT " + ", ".join(f"sum(u{i} * u{j}) AS q{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM u)")
    s = lambda c, i, j: f"{c}{min(i, j)}{max(i, j)}"
    cov = lambda i, j: "(" + " + ".join(f"{s('i', i, a)} * {s('q', a, b)} * {s('i', b, j)}" for a in range(3) for b in range(3)) + ")"
    wald = f"(b1 * b1 * {cov(2, 2)} - 2 * b1 * b2 * {cov(1, 2)} + b2 * b2 * {cov(1, 1)}) / ({cov(1, 1)} * {cov(2, 2)} - {cov(1, 2)} * {cov(1, 2)})"
    return f"WITH {', '.join(parts)} SELECT round(b0, 6) AS intercept, round(b1, 6) AS r, round(b2, 6) AS n, round(rho, 6) AS rho, round({wald}, 5) AS wald FROM b{rounds}, k{rounds}, q"


def _cofactor(i: int, j: int) -> str:
    """Cofactor of a symmetric 3 x 3 matrix m00 .. m22."""
    a, b = [[k for k in range(3) if k != x] for x in (i, j)]
    name = lambda p, q: f"m{min(p, q)}{max(p, q)}"
    minor = f"{name(a[0], b[0])} * {name(a[1], b[1])} - {name(a[0], b[1])} * {name(a[1], b[0])}"
    return minor if (i + j) % 2 == 0 else f"-({minor})"


@query(_gee_sql())
def ss_10_gee(spark, d):
    df = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("r"), (F.col("l_returnflag") == "N").cast("double").alias("n"))
    fit = li.gee_exchangeable(df, "y", ["r", "n"], "l_suppkey")
    row = _row(spark, intercept=float(fit["beta"][0]), r=float(fit["beta"][1]), n=float(fit["beta"][2]), rho=float(fit["rho"]), wald=float(li.wald(fit, [1, 2])))
    return row.withColumn("wald", F.round("wald", 5))


def _glm_sql(rounds: int = 10) -> str:
    """Newton steps of a logistic regression on one regressor, unrolled."""
    parts = ["d AS (SELECT user_id % 5 / 5.0::DOUBLE AS x, user_id % 11 AS g, count(*) FILTER (WHERE value > 30)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY user_id)", "b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for t in range(1, rounds + 1):
        parts.append(f"e{t} AS (SELECT d.*, a, b, 1 / (1 + exp(-a - b * x)) AS mu FROM d, b{t - 1})")
        parts.append(f"i{t} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(n * mu * (1 - mu)) + 1e-10 AS p, sum(n * mu * (1 - mu) * x) AS q, sum(n * mu * (1 - mu) * x * x) + 1e-10 AS r, sum(k - n * mu) AS s, sum((k - n * mu) * x) AS t FROM e{t})")
        parts.append(f"b{t} AS (SELECT a + (r * s - q * t) / (p * r - q * q) AS a, b + (p * t - q * s) / (p * r - q * q) AS b FROM i{t})")
    parts.append(f"c AS (SELECT sum(k - n * mu) AS s, sum((k - n * mu) * x) AS t FROM e{rounds} GROUP BY g), q AS (SELECT count(*) AS g, sum(s * s) AS ss, sum(s * t) AS st, sum(t * t) AS tt FROM c)")
    return f"WITH {', '.join(parts)} SELECT round(z.a, 6) AS intercept, round(z.b, 6) AS slope, round(sqrt((p * p * tt - 2 * p * i.q * st + i.q * i.q * ss) * g / (g - 1)) / (p * r - i.q * i.q), 6) AS se, g::INTEGER AS clusters FROM b{rounds} z, i{rounds} i, q"


@query(_glm_sql())
def ss_11_binomial_glm(spark, d):
    df = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 30).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    df = df.withColumns({"x": F.col("user_id") % 5 / 5.0, "g": F.col("user_id") % 11})
    fit = li.binomial_glm(df, "k", "n", ["x"], "g")
    return _row(spark, intercept=float(fit["beta"][0]), slope=float(fit["beta"][1]), se=float(fit["se"][1]), clusters=int(fit["clusters"]))


_TREND = f"""{_DENSE}, g AS (SELECT site, feature, ln(sum(count) + 0.5::DOUBLE) AS y FROM dense GROUP BY ALL), p AS (SELECT avg(site) AS m, stddev_samp(site) AS s FROM (SELECT DISTINCT site FROM g)),
 x AS (SELECT g.*, (site - m) / s AS x, ((site - m) / s) ** 2 AS q FROM g, p)"""


@query(f"""WITH {_TREND}, c AS (SELECT feature, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(q, q) AS qq, covar_pop(x, q) AS xq, covar_pop(x, y) AS xy, covar_pop(q, y) AS qy, var_pop(y) AS yy FROM x GROUP BY feature),
  t AS (SELECT max(n) AS n, sum(n * (qq * xy * xy - 2 * xq * xy * qy + xx * qy * qy) / (xx * qq - xq * xq)) AS ssr, sum(n * yy) AS tss FROM c) SELECT n, round(ssr / tss, 6) AS r2, round(ssr / 2 / ((tss - ssr) / (n - 3)), 5) AS pseudo_f FROM t""")
def ss_12_multivariate_trend(spark, d):
    g = dense(spark, d).groupBy("site", "feature").agg(F.log(F.sum("count") + 0.5).alias("y"))
    return li.trend_r2(g, "site", "feature", "y").select("n", F.round("r2", 6).alias("r2"), F.round("pseudo_f", 5).alias("pseudo_f"))


@query(f"""WITH {_DENSE}, l AS (SELECT site, position, feature, ln(count + 0.5::DOUBLE) AS y, ((site * 7 + ascii(position)) % 5)::DOUBLE AS x FROM dense),
  rs AS (SELECT *, y - avg(y) OVER (PARTITION BY site, feature) - avg(y) OVER (PARTITION BY position, feature) + avg(y) OVER (PARTITION BY feature) AS ry, x - avg(x) OVER (PARTITION BY site, feature) - avg(x) OVER (PARTITION BY position, feature) + avg(x) OVER (PARTITION BY feature) AS rx
    FROM l WHERE site IN (SELECT site FROM l GROUP BY site HAVING count(DISTINCT position) = 3)),
  fit AS (SELECT feature, sum(rx * ry) ** 2 / sum(rx * rx) AS ssr, sum(ry * ry) AS tss FROM rs GROUP BY feature) SELECT round(sum(ssr) / sum(tss), 6) AS partial_r2 FROM fit""")
def ss_13_cx_12_25_nested_model(spark, d):
    from varve.operators.relational import complete_blocks

    x = ((F.col("site") * 7 + F.ascii("position")) % 5).cast("double")
    df = dense(spark, d).select("site", "position", "feature", F.log(F.col("count") + 0.5).alias("y"), x.alias("x"))
    df = complete_blocks(df, ["site"], "position", 3)
    m = lambda c, *by: F.avg(c).over(win.over([*by, "feature"]))
    two = lambda c: F.col(c) - m(c, "site") - m(c, "position") + m(c)
    s = df.select("feature", two("x").alias("rx"), two("y").alias("ry"))
    f = s.groupBy("feature").agg((F.pow(F.sum(F.col("rx") * F.col("ry")), 2) / F.sum(F.col("rx") * F.col("rx"))).alias("ssr"), F.sum(F.col("ry") * F.col("ry")).alias("tss"))
    return f.agg(F.round(F.sum("ssr") / F.sum("tss"), 6).alias("partial_r2"))


@query("""WITH c AS (SELECT l_extendedprice - avg(l_extendedprice) OVER () AS y, l_quantity - avg(l_quantity) OVER () AS p, (l_partkey % 97)::DOUBLE - avg((l_partkey % 97)::DOUBLE) OVER () AS g, l_tax - avg(l_tax) OVER () AS t FROM lineitem), b AS (SELECT sum(y * t) / sum(t * t) AS ty, sum(p * t) / sum(t * t) AS bp, sum(g * t) / sum(t * t) AS bg FROM c),
  r AS (SELECT y - ty * t AS y, p - bp * t AS p, g - bg * t AS g FROM c, b), s AS (SELECT sum(y * y) AS yy, sum(p * p) AS pp, sum(g * g) AS gg, sum(p * g) AS pg, sum(p * y) AS py, sum(g * y) AS gy FROM r),
  e AS (SELECT yy AS n, yy - py * py / pp AS p, yy - gy * gy / gg AS g, yy - (gg * py * py - 2 * pg * py * gy + pp * gy * gy) / (pp * gg - pg * pg) AS pg FROM s)
  SELECT round((g - pg) / n, 6) + 0.0::DOUBLE AS unique_first, round((p - pg) / n, 6) + 0.0::DOUBLE AS unique_second, round((n - p - g + pg) / n, 6) + 0.0::DOUBLE AS shared, round(pg / n, 6) AS unexplained FROM e""")
def ss_30_variance_partition(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("p"), (F.col("l_partkey") % 97).cast("double").alias("g"), F.col("l_tax").alias("n"))
    return _row(spark, **li.variance_partition(df, "y", ["p"], ["g"], ["n"]))


@query(None)
def ss_31_32_network_calibration(spark, d):
    top = sites(spark, d).withColumn("unit", F.concat_ws("|", "site", "position"))
    alphas = [0.1, 0.2, 0.4]
    e = li.network_edges(top, "unit", "feature", "count", alphas, draws=2)
    return e.groupBy("alpha", "draw").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg((F.col("partial") > 0).cast("int")), 6).alias("positive"))


@query(None)
def ss_34_40_covariance_sensitivity(spark, d):
    p = points(spark, d).withColumns({"p": F.col("site") % 6, "r": F.col("site") % 6 + F.col("x") / 10})
    m = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in ("exponential", "matern32", "matern52")])).alias("kind"), F.lit(3.0).alias("length"), F.lit(0.1).alias("noise"))
    return li.covariance_sensitivity(p, "site", "x", "y", "p", "r", m)


#: normal distribution function by its series at a point {0}; beyond twelve it is zero or one
_CDF = "CASE WHEN abs({0}) > 12 THEN ({0} > 0)::INT::DOUBLE ELSE 0.5 + sign({0}) * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(greatest(abs({0}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))) END"


@query(f"""WITH m AS (SELECT avg(c_acctbal) - 4500 AS e, stddev_samp(c_acctbal) / sqrt(count(*)) AS se FROM customer), t AS (SELECT 1 - ({_CDF.format("((e + 300) / se)")}) AS a, 1 - ({_CDF.format("((300 - e) / se)")}) AS b, ({_CDF.format("((300 - e) / se)")}) - ({_CDF.format("((-300 - e) / se)")}) AS rope FROM m)
  SELECT round(greatest(a, b), 6) AS p, CASE WHEN greatest(a, b) < 0.05 THEN 'equivalent' ELSE 'not_shown' END AS verdict, round(rope, 6) AS rope, 'no_claim' AS unjustified FROM t""")
def ss_35_equivalence(spark, d):
    m, s, n = table(spark, d, "customer").agg(F.avg("c_acctbal"), F.stddev_samp("c_acctbal"), F.count(F.lit(1))).first()
    se = s / n**0.5
    t = li.tost(m - 4500, se, 300.0, True)
    return _row(spark, p=float(t["p"]), verdict=t["verdict"], rope=float(li.rope_mass(m - 4500, se, 300.0)), unjustified=li.tost(m, se, 1.0, False)["verdict"])


#: upper tail of a binomial count, and its bisection for the ends of the interval
_UPPER = "coalesce(list_sum(list_transform(range(kk, n + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(mid) + (n - x) * ln(1 - mid)))), 0)"


@query(f"""WITH RECURSIVE c AS (SELECT event_type, count(*) FILTER (WHERE value > 90) AS k, count(*) AS n FROM events GROUP BY 1),
  b AS (SELECT event_type, k, n, side, k + side AS kk, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM c, (VALUES (0), (1)) s(side)
    UNION ALL SELECT event_type, k, n, side, kk, CASE WHEN tail < CASE WHEN side = 0 THEN 0.025 ELSE 0.975 END THEN mid ELSE lo END, CASE WHEN tail < CASE WHEN side = 0 THEN 0.025 ELSE 0.975 END THEN hi ELSE mid END, i + 1
    FROM (SELECT *, {_UPPER} AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 40)))
  SELECT event_type, k, n, round(max(CASE WHEN side = 0 THEN CASE WHEN k = 0 THEN 0 ELSE lo END END), 6) AS low, round(max(CASE WHEN side = 1 THEN CASE WHEN k = n THEN 1 ELSE lo END END), 6) AS high FROM b WHERE i = 40 GROUP BY event_type, k, n""")
def ss_40_exact_interval(spark, d):
    from varve.functions.mathfn import exact_interval

    c = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("k"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("e", exact_interval("k", "n")).select("event_type", "k", "n", F.round("e.low", 6).alias("low"), F.round("e.high", 6).alias("high"))


@query("WITH u AS (SELECT vec_id % 25 AS d, avg(label) AS v FROM embeddings GROUP BY 1) SELECT round((quantile_cont(v, 0.95) + 0.8416212335729143) * stddev_samp(v), 6) AS mde FROM u")
def ss_38_minimum_effect(spark, d):
    u = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 25).alias("d")).agg(F.avg("label").alias("v"))
    high = win.global_quantiles(u, "v", [0.95])[0]
    return u.agg(F.round((F.lit(high) + 0.8416212335729143) * F.stddev_samp("v"), 6).alias("mde"))


@query(f"""WITH {SQL_LINES}, b AS (SELECT site, campaign, ln(sum(reads) FILTER (WHERE position = 'R')) - ln(sum(reads) FILTER (WHERE position = 'A')) AS c FROM lines GROUP BY ALL), s AS (SELECT site, avg(c) AS m, count(c) AS n FROM b GROUP BY site HAVING count(c) > 0)
  SELECT count(*) AS sites, round(avg(m), 6) AS equal_weight, round(sum(m * n) / sum(n), 6) AS visit_weight FROM s""")
def ss_42_matched_log_contrast(spark, d):
    r = lambda p: F.log(F.sum(F.when(F.col("position") == p, F.col("reads"))))
    b = lines(spark, d).groupBy("site", "campaign").agg((r("R") - r("A")).alias("c"))
    s = b.groupBy("site").agg(F.avg("c").alias("m"), F.count("c").alias("n")).filter("n > 0")
    return s.agg(F.count(F.lit(1)).alias("sites"), F.round(F.avg("m"), 6).alias("equal_weight"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("visit_weight"))


@query("""WITH names(endpoint) AS (VALUES ('view'), ('signup'), ('purchase'), ('missing')), e AS (SELECT event_type, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1)
  SELECT endpoint, round(m, 6) AS effect, round(se, 6) AS se, CASE WHEN m IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM names LEFT JOIN e ON endpoint = event_type""")
def ss_43_cx_22_effect_matrix(spark, d):
    names = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("view", "signup", "purchase", "missing")])).alias("endpoint"))
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    df = names.join(e, F.col("endpoint") == F.col("event_type"), "left")
    return df.select("endpoint", F.round("m", 6).alias("effect"), F.round("se", 6).alias("se"), F.when(F.col("m").isNull(), "unavailable").otherwise("available").alias("status"))


_EXCESS = """w AS (SELECT c_custkey AS k, c_nationkey % 5 AS plate, c_nationkey AS comp, c_acctbal AS v FROM customer), p AS (SELECT a.k, abs(a.v - b.v) AS bc, abs(a.k - b.k) <= 8 AS near, a.comp = b.comp AS same FROM w a JOIN w b ON a.k % 50 = 0 AND a.k <> b.k AND a.plate = b.plate)"""


@query(f"""WITH {_EXCESS}, m AS (SELECT k, avg(bc) FILTER (WHERE near) AS n, avg(bc) FILTER (WHERE NOT near AND same) AS s, avg(bc) FILTER (WHERE NOT near) AS f FROM p GROUP BY k) SELECT k, round(coalesce(s, f) - n, 6) AS excess, s IS NULL AS fallback FROM m WHERE n IS NOT NULL AND coalesce(s, f) IS NOT NULL""")
def ss_44_matched_excess(spark, d):
    """Every fiftieth unit against all of its plate: the pairs of all units would grow with the square."""
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("plate"), F.col("c_nationkey").alias("comp"), F.col("c_acctbal").alias("v"))
    o = w.select(*[F.col(c).alias(f"{c}2") for c in w.columns])
    p = w.filter("k % 50 = 0").join(o, (F.col("plate") == F.col("plate2")) & (F.col("k") != F.col("k2")))
    near, same, bc = F.abs(F.col("k") - F.col("k2")) <= 8, F.col("comp") == F.col("comp2"), F.abs(F.col("v") - F.col("v2"))
    m = p.groupBy("k").agg(F.avg(F.when(near, bc)).alias("n"), F.avg(F.when(~near & same, bc)).alias("s"), F.avg(F.when(~near, bc)).alias("f"))
    m = m.filter("n is not null and coalesce(s, f) is not null")
    return m.select("k", F.round(F.coalesce("s", "f") - F.col("n"), 6).alias("excess"), F.col("s").isNull().alias("fallback"))


@query(None)
def dv_18_20_ordination(spark, d):
    from varve.operators.compose import clr

    c = clr(dense(spark, d), ["site", "position"], "count").withColumn("unit", F.concat_ws("|", "site", "position"))
    s = li.principal_axes(c, "unit", "feature", "clr")
    return s.select("unit", *[F.round(x, 6).alias(x) for x in ("pc1", "pc2", "share1", "share2")])


@query(None)
def dv_19_principal_coordinates(spark, d):
    from varve.operators.compose import bray_curtis
    from varve.plans.diversity import _fine

    b = bray_curtis(_fine(spark, d), "site", "feature", "count").select("i", "j", F.col("bray").alias("distance"))
    c = li.principal_coordinates(b)
    return c.select("unit", "axis", F.round("value", 6).alias("value"), F.round("retained", 6).alias("retained"))


_H = "('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT"


@query(f"""WITH x AS (SELECT l_suppkey % 20 AS b, l_discount AS x, l_quantity AS y FROM lineitem), b AS (SELECT b, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM x GROUP BY b),
  r AS (SELECT row_number() OVER (ORDER BY b) - 1 AS i, * FROM b), k AS (SELECT count(*) AS k FROM b), p AS (SELECT draw, {_H.format("'21', draw, i")} % k AS i FROM r, range(0, 99) d(draw), k)
  SELECT draw, round((sum(n) * sum(sxy) - sum(sx) * sum(sy)) / (sum(n) * sum(sxx) - sum(sx) * sum(sx)), 6) AS slope FROM p JOIN r USING (i) GROUP BY draw""")
def rm_3_refit_bootstrap(spark, d):
    from varve.operators.resample import block_bootstrap

    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("b"), F.col("l_discount").alias("x"), F.col("l_quantity").alias("y"))
    blocks = x.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    s = block_bootstrap(blocks, "b", ["n", "sx", "sy", "sxy", "sxx"], 99, 21)
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select("draw", F.round(slope, 6).alias("slope"))


@query(f"""WITH c AS (SELECT replicate, c_acctbal AS v, {_H.format("'31', replicate, c_custkey")} % 2 AS half FROM customer, range(0, 100) r(replicate)), m AS (SELECT replicate, half, avg(v) AS m, var_samp(v) / count(*) AS s FROM c GROUP BY ALL),
  t AS (SELECT a.replicate, (a.m - b.m) / sqrt(a.s + b.s) AS t FROM m a JOIN m b ON a.replicate = b.replicate AND a.half = 0 AND b.half = 1) SELECT count(*) AS replicates, round(avg((abs(t) >= 1.959964)::INT), 6) AS rejected, round(avg(t * t), 6) AS mean_square FROM t""")
def rm_11_null_calibration(spark, d):
    """How often a two-sample test rejects where halves of the customers are drawn by hash, so that no difference is there: about one in twenty."""
    from varve.operators.resample import draws, hash_draw

    many = draws(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), 100)
    half = hash_draw(31, "draw", "c_custkey") % 2
    side = lambda k: [F.avg(F.when(half == k, F.col("v"))).alias(f"m{k}"), (F.var_samp(F.when(half == k, F.col("v"))) / F.count(F.when(half == k, F.col("v")))).alias(f"s{k}")]
    t = many.groupBy("draw").agg(*side(0), *side(1)).select(((F.col("m0") - F.col("m1")) / F.sqrt(F.col("s0") + F.col("s1"))).alias("t"))
    return t.agg(F.count("t").alias("replicates"), F.round(F.avg((F.abs("t") >= 1.959964).cast("int")), 6).alias("rejected"), F.round(F.avg(F.col("t") * F.col("t")), 6).alias("mean_square"))


@query(f"WITH {SQL_LINES}, g AS (SELECT site, position, sum(reads) AS v FROM lines GROUP BY ALL), top AS (SELECT site, position FROM g ORDER BY v DESC, site, position LIMIT 1) SELECT round((SELECT avg(v) FROM g), 6) AS all_groups, round((SELECT avg(v) FROM g ANTI JOIN top USING (site, position)), 6) AS without_group, round((SELECT avg(v) FROM g ANTI JOIN top USING (site)), 6) AS without_site")
def cx_11_extreme_exclusion(spark, d):
    g = lines(spark, d).groupBy("site", "position").agg(F.sum("reads").alias("v"))
    top = g.orderBy(F.desc("v"), "site", "position").limit(1)
    mean = lambda df, name: df.agg(F.round(F.avg("v"), 6).alias(name))
    out = mean(g, "all_groups").crossJoin(mean(g.join(top.select("site", "position"), ["site", "position"], "left_anti"), "without_group"))
    return out.crossJoin(mean(g.join(top.select("site"), "site", "left_anti"), "without_site"))


_ZONE = "CASE WHEN l_quantity < 10 THEN 'shallow' WHEN l_quantity < 40 THEN 'middle' ELSE 'deep' END"
_ZR = "rank() OVER (PARTITION BY zone ORDER BY {0}) + (count(*) OVER (PARTITION BY zone, {0}) - 1) / 2.0::DOUBLE"


@query(f"""WITH c AS (SELECT l_quantity AS x, l_tax AS y, l_discount AS z, {_ZONE} AS zone FROM lineitem WHERE l_discount IS NOT NULL), r AS (SELECT zone, x, y, {_ZR.format("x")} AS rx, {_ZR.format("y")} AS ry, {_ZR.format("z")} AS rz FROM c),
  s AS (SELECT zone, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r GROUP BY zone)
  SELECT zone, n, round(r, 6) AS r, round(xy, 6) AS rho, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial_rho FROM s""")
def cx_13_gradient_zones(spark, d):
    """Complete cases by zone: linear, rank and partial rank correlation."""
    x = F.col("l_quantity")
    zone = F.when(x < 10, "shallow").when(x < 40, "middle").otherwise("deep")
    c = table(spark, d, "lineitem").dropna(subset=["l_discount"]).select(zone.alias("zone"), x.alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("z"))
    # ranks come from the counts of distinct values, so a zone with most rows is no single task
    c = c.groupBy("zone", "x", "y", "z").agg(F.count(F.lit(1)).alias("w"))
    for v in ("x", "y", "z"):
        n = c.groupBy(F.col("zone").alias("g"), F.col(v).alias("v")).agg(F.sum("w").alias("m"))
        below = F.coalesce(F.sum("m").over(win.over(["g"], "v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        n = n.select("g", "v", (below + (F.col("m") + 1) / 2.0).alias(f"r{v}"))
        c = c.join(n, (F.col("zone") == F.col("g")) & (F.col(v) == F.col("v"))).drop("g", "v")
    w = F.col("w")

    def weighted(a: str, b: str):
        n, ab = F.sum(w), F.sum(w * F.col(a) * F.col(b))
        spread = lambda k: F.sum(w * F.col(k) * F.col(k)) - F.sum(w * F.col(k)) * F.sum(w * F.col(k)) / n
        return (ab - F.sum(w * F.col(a)) * F.sum(w * F.col(b)) / n) / F.sqrt(spread(a) * spread(b))

    s = c.groupBy("zone").agg(F.sum("w").alias("n"), weighted("x", "y").alias("r"), weighted("rx", "ry").alias("xy"), weighted("rx", "rz").alias("xz"), weighted("ry", "rz").alias("yz"))
    partial = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return s.select("zone", "n", F.round("r", 6).alias("r"), F.round("xy", 6).alias("rho"), F.round(partial, 6).alias("partial_rho"))


@query("""WITH o AS (SELECT event_type AS endpoint, w, corr(value, (event_id * w) % 13) AS r FROM events, range(1, 6) t(w) GROUP BY ALL), n AS (SELECT event_type AS endpoint, draw, w, corr(value, (event_id * w + draw * 7) % 17) AS r FROM events, range(1, 6) t(w), range(0, 19) u(draw) GROUP BY ALL),
  m AS (SELECT endpoint, draw, max(abs(r)) AS top FROM n GROUP BY ALL) SELECT o.endpoint, o.w, round(o.r, 6) AS r, round((1 + count(*) FILTER (WHERE m.top >= abs(o.r) - 1e-12)) / (1 + count(*)), 6) AS p FROM o JOIN m ON o.endpoint = m.endpoint GROUP BY o.endpoint, o.w, o.r""")
def cx_14_max_statistic_windows(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("endpoint"), "event_id", "value")
    ws = spark.range(1, 6).select(F.col("id").alias("w"))
    o = ev.crossJoin(F.broadcast(ws)).groupBy("endpoint", "w").agg(F.corr("value", (F.col("event_id") * F.col("w")) % 13).alias("r"))
    draws = ws.crossJoin(spark.range(19).select(F.col("id").alias("draw")))
    n = ev.crossJoin(F.broadcast(draws)).groupBy("endpoint", "draw", "w").agg(F.corr("value", (F.col("event_id") * F.col("w") + F.col("draw") * 7) % 17).alias("q"))
    m = n.groupBy("endpoint", "draw").agg(F.max(F.abs("q")).alias("top"))
    hits = F.count_if(F.col("top") >= F.abs("r") - 1e-12)
    return o.join(m, "endpoint").groupBy("endpoint", "w", "r").agg(((1 + hits) / (1 + F.count(F.lit(1)))).alias("p")).select("endpoint", "w", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@query("""WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id, quality, toxic FROM labels) SELECT 'unlabelled' AS check, count(*) AS n FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT 'orphan', count(*) FROM b ANTI JOIN a USING (doc_id)
  UNION ALL SELECT 'out_of_range', count(*) FROM b WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)""")
def cx_21_completeness(spark, d):
    from varve.operators.contracts import orphans

    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    bad = b.filter(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return n(orphans(a, b, ["doc_id"]), "unlabelled").union(n(orphans(b, a, ["doc_id"]), "orphan")).union(n(bad, "out_of_range"))


_GUILD = f"""{SQL_LINES}, g AS (SELECT substr(kind, 1, 3) AS guild, feature AS grp, sum(reads) FILTER (WHERE campaign = 1996)::DOUBLE AS a, sum(reads) FILTER (WHERE campaign = 1997)::DOUBLE AS b FROM lines GROUP BY ALL),
 w AS (SELECT guild, grp, coalesce(a, 0) / sum(a) OVER (PARTITION BY guild) AS wa, coalesce(b, 0) / sum(b) OVER (PARTITION BY guild) AS wb, substr(grp, 7)::DOUBLE AS t, substr(grp, 7, 1) AS major FROM g),
 m AS (SELECT guild, major, sum(wa) AS ma, sum(wb) AS mb, sum(wa * t) / nullif(sum(wa), 0) AS ta, sum(wb * t) / nullif(sum(wb), 0) AS tb FROM w GROUP BY guild, major)"""


@query(f"""WITH {_GUILD} SELECT guild, round(sum(CASE WHEN ma > 0 AND mb > 0 THEN (ma - mb) * (ta + tb) / 2 ELSE 0 END), 6) AS between, round(sum(CASE WHEN ma > 0 AND mb > 0 THEN (ta - tb) * (ma + mb) / 2 ELSE 0 END), 6) AS within,
  round(sum(CASE WHEN ma > 0 AND mb > 0 THEN 0 ELSE coalesce(ma * ta, 0) - coalesce(mb * tb, 0) END), 6) AS exclusive, round(sum(coalesce(ma * ta, 0) - coalesce(mb * tb, 0)), 6) AS total FROM m GROUP BY guild""")
def cx_23_guild_turnover(spark, d):
    """Turnover of a trait within each guild between two campaigns, by shares of the guild's reads."""
    from varve.operators.compose import trait_turnover

    r = lambda c: F.sum(F.when(F.col("campaign") == c, F.col("reads"))).cast("double")
    g = lines(spark, d).groupBy(F.substring("kind", 1, 3).alias("guild"), F.col("feature").alias("grp")).agg(r(1996).alias("a"), r(1997).alias("b"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.sum(c).over(win.over(["guild"]))
    g = g.withColumns({"wa": share("a"), "wb": share("b"), "t": F.substring("grp", 7, 9).cast("double"), "major": F.substring("grp", 7, 1)})
    out = trait_turnover(g, "major", "t", "wa", "wb", ["guild"])
    return out.select("guild", *[F.round(c, 6).alias(c) for c in ("between", "within", "exclusive", "total")])


_OMIT = f"""{SQL_LINES}, c AS (SELECT DISTINCT campaign AS omitted FROM lines), k AS (SELECT campaign, site, position, kind, sum(reads) AS n FROM lines GROUP BY ALL),
 t AS (SELECT omitted, site, position, kind, sum(CASE WHEN campaign <> omitted THEN n ELSE 0 END) AS n FROM k, c GROUP BY ALL), f AS (SELECT DISTINCT kind FROM lines), u AS (SELECT DISTINCT omitted, site, position FROM t WHERE n > 0),
 l AS (SELECT u.omitted, u.site, u.position, f.kind, ln(coalesce(t.n, 0) + 0.5::DOUBLE) AS l FROM u CROSS JOIN f LEFT JOIN t ON t.omitted = u.omitted AND t.site = u.site AND t.position = u.position AND t.kind = f.kind),
 r AS (SELECT omitted, site, position, kind, l - avg(l) OVER (PARTITION BY omitted, site, position) AS clr FROM l WHERE (omitted, site) IN (SELECT (omitted, site) FROM u GROUP BY omitted, site HAVING count(*) = 3)),
 z AS (SELECT omitted, position, kind, avg(clr) AS m FROM (SELECT omitted, position, kind, clr - avg(clr) OVER (PARTITION BY omitted, site, kind) AS clr FROM r) GROUP BY ALL)"""


@query(f"WITH {_OMIT} SELECT a.omitted, count(*) AS pathways, round(sqrt(sum((a.m - b.m) ** 2)), 6) AS displacement FROM z a JOIN z b ON a.omitted = b.omitted AND a.kind = b.kind AND a.position = 'A' AND b.position = 'R' GROUP BY a.omitted")
def cx_24_pathway_positions(spark, d):
    """Paired displacement of positions over pathways, with each campaign left out in turn."""
    from varve.operators.compose import clr, densify
    from varve.operators.relational import complete_blocks

    k = lines(spark, d).groupBy("campaign", "site", "position", "kind").agg(F.sum("reads").alias("n"))
    whole = k.groupBy("site", "position", "kind").agg(F.sum("n").alias("all"))
    campaigns = k.select(F.col("campaign").alias("omitted")).distinct()
    own = k.withColumnRenamed("campaign", "omitted").withColumnRenamed("n", "own")
    t = whole.crossJoin(F.broadcast(campaigns)).join(own, ["omitted", "site", "position", "kind"], "left")
    t = t.select("omitted", "site", "position", "kind", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n")).filter("n > 0")
    by = ["omitted", "site", "position"]
    c = clr(densify(t, by, "kind", "n", k), by, "n")
    c = complete_blocks(c, ["omitted", "site"], "position", 3).withColumn("z", win.centred("clr", ["omitted", "site", "kind"]))
    m = c.groupBy("omitted", "kind").pivot("position", ["A", "R"]).agg(F.avg("z")).dropna(subset=["A", "R"])
    return m.groupBy("omitted").agg(F.count(F.lit(1)).alias("pathways"), F.round(F.sqrt(F.sum(F.pow(F.col("A") - F.col("R"), 2))), 6).alias("displacement"))


@query(f"""WITH {SQL_LINES}, m AS (SELECT site, avg(reads) AS metric FROM lines WHERE campaign = 1999 GROUP BY site), e AS (SELECT c_nationkey AS site, avg(c_acctbal) AS element FROM customer GROUP BY 1) SELECT m.site, round(metric, 6) AS metric, round(element, 6) AS element FROM m JOIN e ON m.site = e.site""")
def cx_26_site_join(spark, d):
    m = lines(spark, d).filter("campaign = 1999").groupBy("site").agg(F.avg("reads").alias("metric"))
    e = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("site")).agg(F.avg("c_acctbal").alias("element"))
    return m.join(e, "site").select("site", F.round("metric", 6).alias("metric"), F.round("element", 6).alias("element"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 5 = 0 THEN user_id::DOUBLE END, -1) AS first_known, count(*) OVER (PARTITION BY user_id, ts::DATE) > 1 AS repeated FROM events")
def cx_27_dimension_loader(spark, d):
    ev = table(spark, d, "events")
    k = F.col("event_id")
    first = F.coalesce(F.when(k % 3 == 0, F.col("value")), F.when(k % 5 == 0, F.col("user_id").cast("double")), F.lit(-1.0))
    return ev.select("event_id", first.alias("first_known"), (F.count(F.lit(1)).over(win.over(["user_id", F.to_date("ts")])) > 1).alias("repeated"))


@query(f"WITH {SQL_SITES} SELECT feature, site::VARCHAR AS sample, sum(count)::DOUBLE AS count FROM sites GROUP BY ALL")
def src_1_wide_table(spark, d):
    from varve.sources.io import wide_to_long

    names = [str(r[0]) for r in sites(spark, d).select("site").distinct().orderBy("site").collect()]
    t = sites(spark, d).groupBy("feature").pivot("site", [int(n) for n in names]).agg(F.sum("count"))
    row = F.concat_ws("\t", "feature", *[F.coalesce(F.col(n).cast("string"), F.lit("0")) for n in names], F.lit("7"), F.lit("K;P"))
    header = "\t".join(["#OTU ID", *names, "EB1", "Taxon"])
    text = t.select(row.alias("value")).union(spark.range(1).select(F.lit("# Constructed from biom file")))
    return wide_to_long(text, header)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/varve-{uuid.uuid4().hex}"


@query("SELECT c_custkey::VARCHAR AS c_custkey, nullif(CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'NA' ELSE c_name END, '') AS name FROM customer")
def src_5_gzip_text(spark, d):
    """The customers written as gzipped text and read back: the empty string is null, NA a label."""
    from varve.sources.io import read_tsv

    k, path = F.col("c_custkey"), _folder(spark)
    rows = table(spark, d, "customer").select(k, F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, "NA").otherwise(F.col("c_name")).alias("name"))
    rows.write.option("sep", "\t").option("header", True).option("nullValue", "").option("compression", "gzip").csv(path)
    return read_tsv(spark, path)


@query("SELECT 'site=' || c_nationkey AS sample, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def src_6_file_collection(spark, d):
    """One file folder for each nation, read as one table that knows where each row was."""
    from varve.sources.io import read_collection

    path = _folder(spark)
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("site"), "c_custkey", "c_acctbal")
    rows.repartition("site").write.partitionBy("site").option("sep", "\t").option("header", True).csv(path)
    df = read_collection(spark, path, "site=*/*.csv", by_folder=True)
    return df.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("total"))


@query("SELECT n_name || '.txt' AS member, sha256(n_name || chr(10) || n_regionkey) AS sha256, strlen(n_name || chr(10) || n_regionkey) AS length FROM nation")
def src_7_tar_members(spark, d):
    """The nations as files of a tar.gz archive, listed with their checksums."""
    from varve.sources.io import put, tar_members

    out, path = io.BytesIO(), f"{_folder(spark)}/nations.tar.gz"
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for r in table(spark, d, "nation").select("n_name", "n_regionkey").collect():  # a fixed table of 25 rows
            content = f"{r.n_name}\n{r.n_regionkey}".encode()
            info = tarfile.TarInfo(f"{r.n_name}.txt")
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    put(spark, path, out.getvalue())
    return tar_members(spark, path).select("member", "sha256", F.octet_length("content").cast("long").alias("length"))


@query("SELECT r_name AS name, CASE r_regionkey WHEN 1 THEN 'changed' ELSE 'missing' END AS violation FROM region WHERE r_regionkey BETWEEN 1 AND 3")
def src_16_pinned_inputs(spark, d):
    """A file for each region against the checksums that were pinned: one has changed, one is gone and one is empty, which Spark's readers do not list."""
    from varve.sources.io import manifest, put, unpinned

    home = _folder(spark)
    regions = table(spark, d, "region").select("r_regionkey", "r_name")
    for k, name in regions.collect():  # a fixed table of 5 rows
        if k != 3:
            put(spark, f"{home}/{name}", {1: b"other", 2: b""}.get(k, name.encode()))
    name = F.regexp_extract("path", "[^/]+$", 0)
    lock = regions.select(F.col("r_name").alias("path"), F.sha2(F.col("r_name").cast("binary"), 256).alias("sha256"))
    return unpinned(manifest(spark, home).withColumn("path", name), lock).select(F.col("path").alias("name"), "violation")


@query("SELECT n_name AS name, CASE n_nationkey % 5 WHEN 1 THEN 'changed' WHEN 2 THEN 'empty' ELSE 'missing' END AS violation FROM nation WHERE n_nationkey % 5 BETWEEN 1 AND 3")
def src_16_pin_states(spark, d):
    """A file for each nation, written beside one another: those that are gone, empty or of another hash, apart."""
    from varve.sources.io import empty_files, manifest, put, unpinned

    home, nations = _folder(spark), table(spark, d, "nation").select("n_name", (F.col("n_nationkey") % 5).alias("k"))
    rows = nations.filter(~F.col("k").isin(2, 3)).select(F.when(F.col("k") == 1, "other").otherwise(F.col("n_name")).alias("value"), F.col("n_name").alias("file"))
    rows.write.partitionBy("file").option("lineSep", ";").text(home)
    for (name,) in nations.filter("k = 2").select("n_name").collect():  # five of a fixed table of 25 rows; Spark writes no empty files
        put(spark, f"{home}/file={name}/part-none", b"")
    of = lambda df: df.withColumn("path", F.regexp_extract("path", "file=([^/]+)/part[^/]*$", 1)).filter("path <> ''")
    lock = nations.select(F.col("n_name").alias("path"), F.sha2(F.concat("n_name", F.lit(";")).cast("binary"), 256).alias("sha256"))
    return unpinned(of(manifest(spark, home)), lock, of(empty_files(spark, home))).select(F.col("path").alias("name"), "violation")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE round(c_acctbal, 2)::VARCHAR END AS balance, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS positive FROM customer WHERE c_acctbal <> round(c_acctbal, 0)")
def src_13_canonical_text(spark, d):
    from varve.sources.io import canonical

    c = table(spark, d, "customer").filter("c_acctbal <> round(c_acctbal, 0)")
    k = F.col("c_custkey")
    b = F.when(k % 8 == 0, F.lit(float("nan"))).when(k % 4 != 0, F.round("c_acctbal", 2))
    return c.select("c_custkey", canonical(b, "double").alias("balance"), canonical(F.when(k % 5 != 0, F.col("c_acctbal") > 0), "boolean").alias("positive"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY ALL")
def sm_1_windowed_sums(spark, d):
    from varve.streaming.exposure import windowed_sums

    ev = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return windowed_sums(ev, "user_id", "t", "value").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("total", 6).alias("total"), "n")


@query("SELECT doc_id, piece, len FROM (SELECT doc_id, unnest(range(0, 3)) AS piece, length(text) AS len FROM documents)")
def ud_1_4_table_function(spark, d):
    from varve.functions.udtf import pieces

    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("len"))
    return docs.lateralJoin(pieces(F.col("doc_id").outer(), F.lit(3))).select("doc_id", "piece", "len")


@query("WITH u AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT count(*) AS units, round(avg(m), 6) AS mean FROM u")
def ud_2_3_statistic_callback(spark, d):
    from varve.operators.callback import statistic

    u = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    return statistic(u, {"units": F.count(F.lit(1)), "mean": F.round(F.avg("m"), 6)})
