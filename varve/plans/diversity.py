"""Compositional, diversity and dissimilarity operators over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import compose as co
from varve.operators import relational as rel
from varve.operators import vectors
from varve.operators import windows as win
from varve.plans.base import SQL_COUNTS, SQL_LINES, SQL_SITES, counts, lines, sites
from varve.session import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


KEY = ["campaign", "site", "position"]
#: samples by position only, dense over all brands
_DENSE = f"""{SQL_SITES}, s AS (SELECT DISTINCT site, position FROM sites), f AS (SELECT DISTINCT feature FROM sites),
 dense AS (SELECT s.site, s.position, f.feature, coalesce(t.count, 0) AS count FROM s CROSS JOIN f LEFT JOIN sites t ON t.site = s.site AND t.position = s.position AND t.feature = f.feature)"""


def dense(spark, d):
    t = sites(spark, d)
    return co.densify(t, ["site", "position"], "feature", "count", t)


@query(f"""WITH {SQL_COUNTS} SELECT campaign, site, position, sum(count)::BIGINT AS depth, count(*) AS richness, round(ln(sum(count)) - sum(count * ln(count)) / sum(count), 6) AS shannon,
  round(exp(ln(sum(count)) - sum(count * ln(count)) / sum(count)), 5) AS hill1, round(CASE WHEN count(*) > 1 THEN (ln(sum(count)) - sum(count * ln(count)) / sum(count)) / ln(count(*)) END, 6) AS pielou FROM counts GROUP BY campaign, site, position""")
def dv_alpha_diversity(spark, d):
    a = co.alpha_diversity(counts(spark, d), KEY, "count")
    return a.select(*KEY, "depth", "richness", F.round("shannon", 6).alias("shannon"), F.round(F.exp("shannon"), 5).alias("hill1"), F.round("pielou", 6).alias("pielou"))


@query(f"WITH {SQL_COUNTS} SELECT campaign, site, position, feature, round(count / sum(count) OVER (PARTITION BY campaign, site, position), 9) AS share FROM counts")
def dv_1_closure(spark, d):
    return counts(spark, d).select(*KEY, "feature", F.round(co.closure("count", KEY), 9).alias("share"))


@query(f"WITH {_DENSE}, l AS (SELECT *, ln(count + 0.5::DOUBLE) AS l FROM dense) SELECT site, position, feature, round(l - avg(l) OVER (PARTITION BY site, position), 6) AS clr FROM l")
def dv_2_clr(spark, d):
    return co.clr(dense(spark, d), ["site", "position"], "count").select("site", "position", "feature", F.round("clr", 6).alias("clr"))


@query(f"""WITH {_DENSE}, z AS (SELECT *, sum(count) OVER w AS n, sum((count = 0)::INT) OVER w AS k FROM dense WINDOW w AS (PARTITION BY site, position)),
  l AS (SELECT *, ln(CASE WHEN count = 0 THEN 0.65::DOUBLE / n ELSE count / n * (1 - k * 0.65::DOUBLE / n) END) AS l FROM z) SELECT site, position, feature, round(l - avg(l) OVER (PARTITION BY site, position), 6) AS clr FROM l""")
def dv_3_clr_replaced(spark, d):
    return co.clr_replaced(dense(spark, d), ["site", "position"], "count").select("site", "position", "feature", F.round("clr", 6).alias("clr"))


@query(f"""WITH {_DENSE}, l AS (SELECT *, ln(count + CASE WHEN (SELECT max(count) FROM dense) > 100 THEN 1.0::DOUBLE ELSE 1e-6 END) AS l FROM dense) SELECT site, position, feature, round(l - avg(l) OVER (PARTITION BY site, position), 6) AS clr FROM l""")
def dv_4_clr_adaptive(spark, d):
    return co.clr_adaptive(dense(spark, d), ["site", "position"], "count").select("site", "position", "feature", F.round("clr", 6).alias("clr"))


@query(f"WITH {SQL_SITES} SELECT site, position, round(ln(sum(count) FILTER (WHERE feature IN ('Brand#11', 'Brand#21', 'Brand#31')) + 0.5::DOUBLE) - ln(sum(count) FILTER (WHERE feature NOT IN ('Brand#11', 'Brand#21', 'Brand#31')) + 0.5::DOUBLE), 6) AS ratio FROM (SELECT * FROM sites UNION ALL SELECT DISTINCT site, position, f, 0 FROM sites, (VALUES ('Brand#11'), ('none')) v(f)) GROUP BY ALL")
def dv_5_guild_log_ratio(spark, d):
    member = F.col("feature").isin("Brand#11", "Brand#21", "Brand#31")
    return sites(spark, d).groupBy("site", "position").agg(F.round(co.guild_log_ratio("count", member), 6).alias("ratio"))


@query(f"""WITH {SQL_SITES}, t AS (SELECT *, sum(count) OVER (PARTITION BY site, position) AS n FROM sites)
  SELECT site, position, max(n)::BIGINT AS depth, round(CASE WHEN max(n) >= 200 THEN sum(1 - CASE WHEN n - count < 200 THEN 0 ELSE exp(lgamma(n - count + 1) - lgamma(n - count - 200 + 1) - lgamma(n + 1) + lgamma(n - 200 + 1)) END) END, 5) AS expected_richness FROM t GROUP BY site, position""")
def dv_9_11_expected_richness(spark, d):
    e = co.expected_richness(sites(spark, d), ["site", "position"], "count", 200)
    return e.select("site", "position", "depth", F.round("expected_richness", 5).alias("expected_richness"))


@query(f"WITH {SQL_COUNTS}, t AS (SELECT sum(count)::DOUBLE AS n FROM counts GROUP BY campaign, site, position) SELECT greatest(1000, floor(quantile_cont(n, 0.05) / 1000) * 1000)::BIGINT AS depth FROM t")
def dv_10_rarefaction_depth(spark, d):
    t = counts(spark, d).groupBy(*KEY).agg(F.sum("count").cast("double").alias("n"))
    low = win.global_quantiles(t, "n", [0.05])
    return spark.range(1).select(F.greatest(F.lit(1000), F.floor(F.lit(low[0] if low else None) / 1000) * 1000).cast("long").alias("depth"))


_RARE = f"""{_DENSE}, known AS (SELECT site, position, feature, count AS c, (200::DOUBLE + 10 * sqrt(200::DOUBLE) + 20) / sum(count) OVER (PARTITION BY site, position)::DOUBLE AS share FROM dense WHERE count > 0),
 keyed AS (SELECT *, CASE WHEN share < 1 THEN -ln(1 - share) END AS level, CASE WHEN share < 1 THEN least(c, ceil(c * share + 10 * sqrt(c * share) + 20)::BIGINT) ELSE c END AS keys FROM known),
 reads AS (SELECT keyed.*, draw, unnest(generate_series(1, keys)) AS read FROM keyed, range(0, 5) r(draw)),
 drawn AS (SELECT *, sum(-ln((('0x' || substr(md5(concat_ws('|', '7', draw, site, position, feature, read)), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656::DOUBLE) / (c - read + 1))
   OVER (PARTITION BY site, position, feature, draw ORDER BY read ROWS UNBOUNDED PRECEDING) AS key FROM reads),
 rare AS (SELECT draw, site, position, feature, count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY site, position, draw ORDER BY key, feature, read) AS place FROM drawn WHERE level IS NULL OR key <= level) WHERE place <= 200 GROUP BY ALL)"""


def _rare(spark, d):
    return co.rarefied_counts(dense(spark, d), ["site", "position"], "feature", "count", 200, 5, 7)


@query(f"WITH {_RARE} SELECT draw, site, position, feature, count FROM rare")
def dv_12_rarefied_counts(spark, d):
    return _rare(spark, d)


@query(f"WITH {_RARE}, seen AS (SELECT site, position, feature FROM rare GROUP BY ALL HAVING count(*) >= 0.5 * 5) SELECT feature, count(*) AS occupancy FROM seen GROUP BY feature HAVING count(*) >= 0.9 * (SELECT count(*) FROM s)")
def dv_13_core_set(spark, d):
    seen = _rare(spark, d).groupBy("site", "position", "feature").agg(F.count("*").alias("n")).filter("n >= 0.5 * 5")
    units = sites(spark, d).select("site", "position").distinct().agg(F.count(F.lit(1)).alias("units"))
    core = seen.groupBy("feature").agg(F.count("*").alias("occupancy")).crossJoin(F.broadcast(units))
    return core.filter("occupancy >= 0.9 * units").select("feature", "occupancy")


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]) ** 2))), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id")
def dv_14_euclidean_distances(spark, d):
    """Distances of every fiftieth vector to all others: the whole pair table would grow with the square."""
    e = table(spark, d, "embeddings")
    return vectors.distances(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 6)


_SITE = f"{SQL_LINES}, m AS (SELECT site, feature, sum(reads)::BIGINT AS count FROM lines GROUP BY ALL)"
#: the same by brand and type, so that features are absent from some sites
_FINE = f"{SQL_LINES}, m AS (SELECT site, feature || kind AS feature, sum(reads)::BIGINT AS count FROM lines GROUP BY ALL)"


def _site(spark, d):
    return lines(spark, d).groupBy("site", "feature").agg(F.sum("reads").alias("count"))


def _fine(spark, d):
    return lines(spark, d).groupBy("site", F.concat("feature", "kind").alias("feature")).agg(F.sum("reads").alias("count"))


@query(f"""WITH {_FINE}, t AS (SELECT site, sum(count) AS n FROM m GROUP BY site), s AS (SELECT a.site AS i, b.site AS j, sum(least(a.count, b.count)) AS s FROM m a JOIN m b ON a.feature = b.feature AND a.site < b.site GROUP BY ALL),
  g AS (SELECT a.site AS i, b.site AS j, a.n AS ti, b.n AS tj, coalesce(s, 0) AS s FROM t a JOIN t b ON a.site < b.site LEFT JOIN s ON s.i = a.site AND s.j = b.site),
  h AS (SELECT i, j, 1 - 2 * s / (ti + tj) AS bray, coalesce(least(ti - s, tj - s) / nullif(s + least(ti - s, tj - s), 0), 0) AS balanced FROM g)
  SELECT i, j, round(bray, 9) AS bray, round(balanced, 9) AS balanced, round(bray - balanced, 9) AS gradient FROM h""")
def dv_15_16_bray_curtis(spark, d):
    b = co.bray_curtis(_fine(spark, d), "site", "feature", "count")
    return b.select("i", "j", *[F.round(c, 9).alias(c) for c in ("bray", "balanced", "gradient")])


@query(f"""WITH {_FINE}, t AS (SELECT site, count(*) AS n FROM m GROUP BY site), s AS (SELECT a.site AS i, b.site AS j, count(*) AS s FROM m a JOIN m b ON a.feature = b.feature AND a.site < b.site GROUP BY ALL),
  g AS (SELECT a.site AS i, b.site AS j, a.n - coalesce(s, 0) AS p, b.n - coalesce(s, 0) AS q, coalesce(s, 0) AS s FROM t a JOIN t b ON a.site < b.site LEFT JOIN s ON s.i = a.site AND s.j = b.site),
  h AS (SELECT i, j, coalesce((p + q) / nullif(2 * s + p + q, 0), 0) AS w, coalesce(least(p, q) / nullif(s + least(p, q), 0), 0) AS t FROM g)
  SELECT i, j, round(w, 9) AS sorensen, round(t, 9) AS turnover, round(w - t, 9) AS nestedness FROM h""")
def dv_17_sorensen(spark, d):
    b = co.sorensen(_fine(spark, d), "site", "feature")
    return b.select("i", "j", *[F.round(c, 9).alias(c) for c in ("sorensen", "turnover", "nestedness")])


_TRAIT = f"""{SQL_LINES}, w AS (SELECT feature, kind AS grp, sum(reads) FILTER (WHERE campaign = 1996)::DOUBLE AS a, sum(reads) FILTER (WHERE campaign = 1998)::DOUBLE AS b FROM lines WHERE position <> 'N' GROUP BY ALL),
 u AS (SELECT *, coalesce(a, 0) / sum(a) OVER () AS wa, CASE WHEN grp LIKE 'S%' THEN 0 ELSE coalesce(b, 0) END / sum(b) OVER () AS wb, substr(feature, 7)::DOUBLE AS trait FROM w)"""


def _trait(spark, d):
    t = lines(spark, d).filter("position <> 'N'").groupBy("feature", F.col("kind").alias("grp"))
    t = t.agg(F.sum(F.when(F.col("campaign") == 1996, F.col("reads"))).alias("a"), F.sum(F.when(F.col("campaign") == 1998, F.col("reads"))).alias("b"))
    wb = F.when(F.col("grp").startswith("S"), 0).otherwise(F.coalesce("b", F.lit(0)))
    return t.withColumns(
        {"wa": F.coalesce("a", F.lit(0)) / F.sum("a").over(win.over([])), "wb": wb / F.sum("b").over(win.over([])), "trait": F.substring("feature", 7, 9).cast("double")}
    )


@query(f"""WITH {_TRAIT}, g AS (SELECT grp, sum(wa) AS ma, sum(wb) AS mb, sum(wa * trait) / nullif(sum(wa), 0) AS ta, sum(wb * trait) / nullif(sum(wb), 0) AS tb FROM u GROUP BY grp)
  SELECT round(sum(CASE WHEN ma > 0 AND mb > 0 THEN (ma - mb) * (ta + tb) / 2 ELSE 0 END), 9) AS between, round(sum(CASE WHEN ma > 0 AND mb > 0 THEN (ta - tb) * (ma + mb) / 2 ELSE 0 END), 9) AS within,
   round(sum(CASE WHEN ma > 0 AND mb > 0 THEN 0 ELSE coalesce(ma * ta, 0) - coalesce(mb * tb, 0) END), 9) AS exclusive, round(sum(coalesce(ma * ta, 0) - coalesce(mb * tb, 0)), 9) AS total FROM g""")
def dv_21_trait_turnover(spark, d):
    t = co.trait_turnover(_trait(spark, d), "grp", "trait", "wa", "wb")
    return t.select(*[F.round(c, 9).alias(c) for c in t.columns])


@query(f"WITH {_SITE} SELECT site, round(100 * sum(count * substr(feature, 7)::DOUBLE) / sum(count), 6) AS score, bool_or(feature IN ('Brand#12', 'Brand#45')) AS has_any FROM m GROUP BY site")
def dv_22_23_trait_scores(spark, d):
    t = _site(spark, d).withColumn("trait", F.substring("feature", 7, 9).cast("double"))
    return t.groupBy("site").agg(
        F.round(100 * F.sum(F.col("count") * F.col("trait")) / F.nullif(F.sum("count"), F.lit(0)), 6).alias("score"), F.bool_or(F.col("feature").isin("Brand#12", "Brand#45")).alias("has_any")
    )


@query(f"""WITH {SQL_SITES}, called AS (SELECT feature FROM sites GROUP BY feature HAVING sum(count) % 3 = 0), kept AS (SELECT * FROM sites WHERE feature NOT IN (SELECT feature FROM called))
  SELECT site, position, sum(count)::BIGINT AS depth, count(*) AS richness, round(ln(sum(count)) - sum(count * ln(count)) / sum(count), 6) AS shannon FROM kept GROUP BY ALL""")
def dv_24_filtered_rebuild(spark, d):
    s = sites(spark, d)
    called = s.groupBy("feature").agg(F.sum("count").alias("n")).filter("n % 3 = 0").select("feature")
    a = co.alpha_diversity(s.join(called, "feature", "left_anti"), ["site", "position"], "count")
    return a.select("site", "position", "depth", "richness", F.round("shannon", 6).alias("shannon"))


@query(f"WITH {SQL_LINES} SELECT site, position, sum(reads)::BIGINT AS count FROM lines GROUP BY ALL")
def cx_18_site_position_pool(spark, d):
    return rel.pool(lines(spark, d), ["site", "position"], "reads").select("site", "position", F.col("reads").alias("count"))
