"""Projections, joins, aggregates, sorts, sets and reshaping over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import relational as rel
from varve.operators import vectors
from varve.operators import windows as win
from varve.operators.compose import shannon
from varve.plans.base import SQL_COUNTS, SQL_DAILY, SQL_LINES, counts, daily, lines, visits
from varve.session import table

QUERIES: dict = {}


def query(sql: str | None):
    """Registers a query with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# --- scans -----------------------------------------------------------------


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderstatus")
def src_2_3_projected_scan(spark, d):
    df = table(spark, d, "orders").filter("o_totalprice > 50000")
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def src_4_row_limited_scan(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT item_id, position::BIGINT AS line_number, line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS position FROM benchmark)")
def src_8_text_record_scan(spark, d):
    df = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return df.select("item_id", (F.col("p") + 1).cast("long").alias("line_number"), "line")


@query("SELECT source, token, count(*) AS n FROM (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8}'))) AS token FROM documents) GROUP BY source, token HAVING count(*) >= 3")
def src_9_annotation_lists(spark, d):
    df = table(spark, d, "documents")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8}"), F.lit(0)))
    df = df.select("source", F.explode(tokens).alias("token"))
    return df.groupBy("source", "token").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def src_11_json_documents(spark, d):
    df = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return df.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT item_id, sha256(text) AS sha256, md5(text) AS md5 FROM benchmark")
def src_14_sc_20_checksums(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


# --- projections -------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
  round(l_extendedprice * (1 - l_discount), 4) AS net, CASE l_returnflag WHEN 'R' THEN 'Rhizosphere' WHEN 'A' THEN 'Surface' END AS position
  FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_linestatus IN ('F', 'X')""")
def prj_1_2_6_derive_recode_range(spark, d):
    df = table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 12) & F.col("l_linestatus").isin("F", "X"))
    labels = F.create_map(F.lit("R"), F.lit("Rhizosphere"), F.lit("A"), F.lit("Surface"))
    return df.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        labels[F.col("l_returnflag")].alias("position"),
    )


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 9000 AND c_nationkey < 5 THEN CASE WHEN rna IS NULL THEN 'unknown_full_HQ_missing_rna' WHEN rna THEN 'high' ELSE 'high_without_rna' END
  WHEN c_acctbal >= 5000 AND c_nationkey < 10 THEN 'medium' WHEN c_acctbal >= 5000 AND c_nationkey = 10 THEN 'medium_boundary' ELSE 'fail' END AS tier
  FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END AS rna FROM customer)""")
def prj_3_quality_ladder(spark, d):
    df = table(spark, d, "customer").withColumn("rna", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 3 == 1))
    high = F.when(F.col("rna").isNull(), "unknown_full_HQ_missing_rna").when(F.col("rna"), "high").otherwise("high_without_rna")
    half = F.col("c_acctbal") >= 5000
    tier = (
        F.when((F.col("c_acctbal") > 9000) & (F.col("c_nationkey") < 5), high)
        .when(half & (F.col("c_nationkey") < 10), "medium")
        .when(half & (F.col("c_nationkey") == 10), "medium_boundary")
        .otherwise("fail")
    )
    return df.select("c_custkey", tier.alias("tier"))


@query("""SELECT conv_id, turn, partial, CASE WHEN partial IS NULL THEN NULL WHEN n <= 4 OR least(rank - 1, n - rank) < 2 THEN true ELSE false END AS edge,
  CASE WHEN partial IS NULL THEN NULL ELSE NOT partial AND NOT (n <= 4 OR least(rank - 1, n - rank) < 2) END AS eligible
  FROM (SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE length(text) % 7 = 1 END AS partial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def prj_4_wn_15_three_valued_audit(spark, d):
    df = table(spark, d, "conversations").withColumn("partial", F.when(F.length("text") % 7 != 0, F.length("text") % 7 == 1))
    ends = win.distance_to_ends(["conv_id"], "turn")
    near = (F.count("*").over(win.over(["conv_id"])) <= 4) | (ends < 2)
    df = df.withColumn("near", near)
    known = F.col("partial").isNotNull()
    return df.select("conv_id", "turn", "partial", F.when(known, F.col("near")).alias("edge"), F.when(known, ~F.col("partial") & ~F.col("near")).alias("eligible"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, 'blog') THEN 'blog' WHEN regexp_matches(url, '^https') THEN 'secure' WHEN regexp_matches(url, 'net/') THEN 'net' ELSE 'other' END AS class FROM pages""")
def prj_5_first_matching_rule(spark, d):
    rules = [("blog", "blog"), ("^https", "secure"), ("net/", "net")]
    label = F.coalesce(*[F.when(F.col("url").rlike(p), F.lit(v)) for p, v in rules], F.lit("other"))
    return table(spark, d, "pages").select("page_id", label.alias("class"))


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey::VARCHAR || '.5' WHEN s_suppkey % 7 = 0 THEN 'x' ELSE s_nationkey::VARCHAR END AS label FROM supplier)
  SELECT s_suppkey, label, TRY_CAST(CASE WHEN regexp_matches(label, '^[0-9]+$') THEN label END AS INTEGER)::BIGINT AS site, TRY_CAST(label AS DOUBLE) AS number FROM t""")
def prj_7_8_17_label_guards(spark, d):
    key = F.col("s_suppkey")
    label = F.when(key % 5 == 0, F.concat(F.col("s_nationkey").cast("string"), F.lit(".5"))).when(key % 7 == 0, "x").otherwise(F.col("s_nationkey").cast("string"))
    df = table(spark, d, "supplier").select("s_suppkey", label.alias("label"))
    site = F.when(F.col("label").rlike("^[0-9]+$"), F.col("label").try_cast("int")).cast("long")
    return df.select("s_suppkey", "label", site.alias("site"), F.col("label").try_cast("double").alias("number"))


@query("""SELECT doc_id, quality::BIGINT AS quality FROM labels SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id) WHERE quality IS NOT NULL""")
def prj_9_10_jn_5_semi_filter(spark, d):
    english = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return table(spark, d, "labels").dropna(subset=["quality"]).join(english, "doc_id", "left_semi").select("doc_id", F.col("quality").cast("long").alias("quality"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE abs(a - b) <= 1e-12 OR (a IS NULL AND b IS NULL)) AS close FROM
  (SELECT l_discount AS a, CASE WHEN l_orderkey % 2 = 0 THEN l_discount + 1e-13 ELSE l_discount + 1e-6 END AS b FROM lineitem)""")
def prj_11_float_tolerance(spark, d):
    a = F.col("l_discount")
    b = F.when(F.col("l_orderkey") % 2 == 0, a + 1e-13).otherwise(a + 1e-6)
    close = (F.abs(a - b) <= 1e-12) | a.eqNullSafe(b)
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(close).alias("close"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND NOT (value > 50 OR user_id % 10 = 3)")
def prj_12_quarantine(spark, d):
    bad = (F.col("value") > 50) | (F.col("user_id") % 10 == 3)
    return table(spark, d, "events").filter((F.col("event_type") == "view") & ~bad).select("event_id")


@query(f"""WITH {SQL_COUNTS} SELECT * FROM counts SEMI JOIN (SELECT campaign, site, position FROM counts GROUP BY ALL HAVING sum(count) >= 500) USING (campaign, site, position)""")
def prj_13_minimum_support(spark, d):
    return rel.with_support(counts(spark, d), ["campaign", "site", "position"], "count", 500)


@query("""SELECT 'duplicate' AS violation, l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'vocabulary', c_custkey, 1 FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
  UNION ALL SELECT 'blank', o_orderkey, 1 FROM orders WHERE o_orderpriority IS NULL OR trim(o_orderpriority) <> o_orderpriority""")
def prj_14_ag_16_contract_violations(spark, d):
    from varve.operators.contracts import not_in_vocabulary, padded_or_null

    twice = rel.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("duplicate").alias("violation"), F.col("l_orderkey").alias("key"), "n")
    words = not_in_vocabulary(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"])
    blank = padded_or_null(table(spark, d, "orders"), "o_orderpriority")
    one = lambda df, kind, key: df.select(F.lit(kind).alias("violation"), F.col(key).alias("key"), F.lit(1).cast("long").alias("n"))
    return twice.union(one(words, "vocabulary", "c_custkey")).union(one(blank, "blank", "o_orderkey"))


@query("""SELECT c_custkey, arg_min(g, abs(g * 500 - c_acctbal) * 1000 + g)::BIGINT AS grid, greatest(0, least(1, c_acctbal / 5000)) AS clipped
  FROM customer, range(0, 21) r(g) GROUP BY c_custkey, c_acctbal""")
def prj_15_16_nearest_grid_clip(spark, d):
    grid = spark.range(21).select(F.col("id").alias("g"))
    df = table(spark, d, "customer").crossJoin(F.broadcast(grid))
    near = F.min_by("g", F.struct(F.abs(F.col("g") * 500 - F.col("c_acctbal")), "g"))
    df = df.groupBy("c_custkey", "c_acctbal").agg(near.alias("grid"))
    return df.select("c_custkey", "grid", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 5000)).alias("clipped"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 100.0 ELSE p_size END AS raw, CASE WHEN p_size % 2 = 0 THEN 'fraction' ELSE 'percent' END AS scale, p_size::DOUBLE AS percent FROM part")
def prj_18_declared_scale(spark, d):
    even = F.col("p_size") % 2 == 0
    df = table(spark, d, "part").select("p_partkey", F.when(even, F.col("p_size") / 100.0).otherwise(F.col("p_size").cast("double")).alias("raw"), F.when(even, "fraction").otherwise("percent").alias("scale"))
    value = F.when(F.col("scale") == "fraction", F.round(F.col("raw") * 100, 9)).otherwise(F.col("raw"))
    return df.withColumn("percent", F.when(value.between(0, 100), value).otherwise(F.raise_error(F.lit("scale out of bounds"))))


# --- joins -------------------------------------------------------------------


@query("""SELECT n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def jn_1_2_inner_left(spark, d):
    df = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = df.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return df.groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers"))


_VERSIONS = """old AS (SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 11 <> 0),
 new AS (SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS price,
   CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 13 <> 0)"""


def _versions(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.filter(k % 11 != 0).select("o_orderkey", F.round("o_totalprice", 2).alias("price"), F.col("o_orderpriority").alias("priority"))
    price = F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = o.filter(k % 13 != 0).select("o_orderkey", F.round(price, 2).alias("price"), F.when(k % 5 == 0, "x").otherwise(F.col("o_orderpriority")).alias("priority"))
    return old, new


@query(f"""WITH {_VERSIONS} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'ADDED' WHEN n.o_orderkey IS NULL THEN 'ABSENT'
  WHEN n.price IS DISTINCT FROM o.price THEN 'REVISED_VALUE' WHEN n.priority IS DISTINCT FROM o.priority THEN 'REVISED_METADATA' ELSE 'UNCHANGED' END AS status
  FROM new n FULL JOIN old o ON n.o_orderkey = o.o_orderkey""")
def jn_3_version_diff(spark, d):
    old, new = _versions(spark, d)
    return rel.version_diff(old, new, "o_orderkey", ["price"], ["priority"])


@query(f"""WITH {_VERSIONS} SELECT 'price' AS "column", count(*) FILTER (WHERE n.price IS DISTINCT FROM o.price) AS changed FROM new n JOIN old o USING (o_orderkey)
  UNION ALL SELECT 'priority', count(*) FILTER (WHERE n.priority IS DISTINCT FROM o.priority) FROM new n JOIN old o USING (o_orderkey)""")
def cx_1_19_20_column_changes(spark, d):
    old, new = _versions(spark, d)
    return rel.column_changes(old, new, "o_orderkey", ["price", "priority"])


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def jn_4_validated_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return rel.validated_join(o, c, ["c_custkey"], validate="many_to_one").select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def jn_6_unmatched_keys(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, concat_ws('|', lang, source) AS key FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def jn_7_18_lookup_with_default(spark, d):
    q = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    df = table(spark, d, "documents").join(q, "doc_id", "left")
    return df.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.concat_ws("|", "lang", "source").alias("key"))


@query("""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN n_name || 'sta' WHEN c_custkey % 9 = 0 THEN 'nowhere' ELSE n_name END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c_custkey, coalesce(e.n_regionkey, f.n_regionkey)::BIGINT AS region, CASE WHEN e.n_name IS NOT NULL THEN 'exact' WHEN f.n_name IS NOT NULL THEN 'suffix_fallback' ELSE 'unmatched' END AS resolution
  FROM l LEFT JOIN nation e ON l.label = e.n_name LEFT JOIN nation f ON regexp_replace(l.label, 'sta$', '') = f.n_name""")
def jn_8_fallback_join(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").cast("long").alias("region"))
    k = F.col("c_custkey")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.when(k % 4 == 0, F.concat("n_name", F.lit("sta"))).when(k % 9 == 0, "nowhere").otherwise(F.col("n_name")).alias("label"))
    return rel.fallback_join(c, n, "label", F.regexp_replace("label", "sta$", ""), "region").select("c_custkey", "region", "resolution")


@query(f"WITH {SQL_DAILY} SELECT visit, v.site, v.date, round(mm, 6) AS mm FROM visits v LEFT JOIN daily d ON v.site = d.site AND v.date = d.date")
def jn_11_exact_date_lookup(spark, d):
    df = visits(spark, d).join(daily(spark, d), ["site", "date"], "left")
    return df.select("visit", "site", "date", F.round("mm", 6).alias("mm"))


@query("""SELECT a.s_suppkey AS s_suppkey_i, b.s_suppkey AS s_suppkey_j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def jn_13_unordered_pairs(spark, d):
    return rel.pairs(table(spark, d, "supplier"), "s_suppkey", ["s_nationkey"]).select("s_suppkey_i", "s_suppkey_j")


_POINTS = "points AS (SELECT n_nationkey::BIGINT AS site, 45 + 0.5 * n_nationkey + (n_nationkey * 7 % 5) AS x, 18 + 0.3 * n_nationkey + (n_nationkey * 11 % 7) AS y FROM nation)"


def points(spark, d):
    k = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(k.alias("site"), (45 + 0.5 * k + (k * 7 % 5)).cast("double").alias("x"), (18 + 0.3 * k + (k * 11 % 7)).cast("double").alias("y"))


_KNN = f"""{_POINTS}, d AS (SELECT a.site AS i, b.site AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::DOUBLE AS distance FROM points a, points b WHERE a.site <> b.site),
 near AS (SELECT i, j, distance FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(distance, 9), j) <= 5)"""


@query(f"WITH {_KNN} SELECT i, j, round(distance, 6) AS distance FROM near")
def jn_14_15_nearest_neighbours(spark, d):
    return rel.nearest(points(spark, d), "site", "x", "y", 5).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_KNN} SELECT DISTINCT i, j FROM (SELECT i, j FROM near UNION ALL SELECT j, i FROM near)")
def jn_14_symmetric_weights(spark, d):
    return rel.symmetric_edges(rel.nearest(points(spark, d), "site", "x", "y", 5))


@query(f"WITH {SQL_COUNTS} SELECT campaign, site, count(*) AS n FROM counts WHERE (campaign, site) IN (SELECT (campaign, site) FROM counts GROUP BY campaign, site HAVING count(DISTINCT position) = 3) GROUP BY ALL")
def jn_16_complete_blocks(spark, d):
    return rel.complete_blocks(counts(spark, d), ["campaign", "site"], "position", 3).groupBy("campaign", "site").agg(F.count("*").alias("n"))


_ANNOTATION = "annotation AS (SELECT DISTINCT p_brand AS feature, p_type AS trait, 1 + length(p_type) % 3 AS copies FROM part)"


@query(f"WITH {SQL_COUNTS}, {_ANNOTATION} SELECT site, trait, sum(count * copies)::BIGINT AS value FROM counts JOIN annotation USING (feature) GROUP BY ALL")
def jn_17_matrix_product(spark, d):
    ann = table(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_type").alias("trait"), (1 + F.length("p_type") % 3).alias("copies")).distinct()
    return rel.matrix_product(counts(spark, d), ann, "feature", ["site", "trait"], "count", "copies")


@query("""WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
  SELECT DISTINCT id FROM (SELECT j AS id FROM p WHERE c >= 0.6 UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 50 = 7)""")
def jn_19_similar_duplicates(spark, d):
    e = table(spark, d, "embeddings")
    near = vectors.with_alike(e.filter("vec_id % 2 = 1"), e.filter("vec_id % 2 = 0"), "vec_id", "embedding", 0.6, ["label"])
    return near.union(e.filter("vec_id % 50 = 7").select(F.col("vec_id").alias("id"))).distinct()


# --- aggregates ----------------------------------------------------------------


@query(f"WITH {SQL_LINES} SELECT campaign, site, position, sum(reads)::BIGINT AS library, count(*) AS n, count(DISTINCT profile) AS n_profiles, sum(reads) >= 2000 AS retained FROM lines GROUP BY ALL")
def ag_1_5_pooled_replicates(spark, d):
    return lines(spark, d).groupBy("campaign", "site", "position").agg(
        F.sum("reads").alias("library"), F.count("*").alias("n"), F.countDistinct("profile").alias("n_profiles"), (F.sum("reads") >= 2000).alias("retained")
    )


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_q, round(sum(l_extendedprice), 2) AS total, count(*) AS n, round(stddev_samp(l_discount), 6) AS sd, min(l_linestatus) AS first_status FROM lineitem GROUP BY 1")
def ag_2_named_aggregates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_q"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.count("*").alias("n"),
        F.round(F.stddev_samp("l_discount"), 6).alias("sd"),
        F.min("l_linestatus").alias("first_status"),
    )


@query(f"WITH {SQL_LINES} SELECT site, round(avg(m), 6) AS site_mean FROM (SELECT site, campaign, avg(reads) AS m FROM lines GROUP BY ALL) GROUP BY site")
def ag_3_cx_10_mean_of_means(spark, d):
    df = lines(spark, d).groupBy("site", "campaign").agg(F.avg("reads").alias("m"))
    return df.groupBy("site").agg(F.round(F.avg("m"), 6).alias("site_mean"))


@query(f"""WITH {SQL_LINES} SELECT level, name, site, sum(reads)::BIGINT AS count FROM (
  SELECT site, reads, 'kind' AS level, kind AS name FROM lines UNION ALL SELECT site, reads, 'feature', CASE WHEN feature = 'Brand#11' THEN 'unclassified_feature' ELSE feature END FROM lines) GROUP BY ALL""")
def ag_4_lineage_rollup(spark, d):
    brand = F.when(F.col("feature") == "Brand#11", "unclassified_feature").otherwise(F.col("feature"))
    df = lines(spark, d).groupBy("site", "kind", brand.alias("feature")).agg(F.sum("reads").alias("count"))
    levels = F.array(F.struct(F.lit("kind").alias("level"), F.col("kind").alias("name")), F.struct(F.lit("feature").alias("level"), F.col("feature").alias("name")))
    return df.select("site", "count", F.inline(levels)).groupBy("level", "name", "site").agg(F.sum("count").alias("count"))


@query("SELECT user_id, count(*) FILTER (WHERE value >= 5) AS wet, round(avg((value >= 5)::INT), 6) AS share, round(sum(value * event_id) / sum(event_id), 6) AS weighted FROM events GROUP BY user_id")
def ag_6_13_conditional_weighted(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(v >= 5).alias("wet"), F.round(F.avg((v >= 5).cast("int")), 6).alias("share"), F.round(F.sum(v * F.col("event_id")) / F.sum("event_id"), 6).alias("weighted")
    )


@query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.975), 6) AS q975 FROM events GROUP BY 1")
def ag_7_quantiles(spark, d):
    q = win.grouped_quantiles(table(spark, d, "events"), "value", {"median": 0.5, "q05": 0.05, "q975": 0.975}, ["event_type"])
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "q05", "q975")])


@query("SELECT p_brand, p_type AS mode, n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def ag_8_mode(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return win.first_per_key(n, ["p_brand"], F.desc("n"), "p_type").select("p_brand", F.col("p_type").alias("mode"), "n")


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def ag_9_value_counts(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(win.over([])), 6))


@query("SELECT c_mktsegment, count(*) FILTER (WHERE r = 0) AS r0, count(*) FILTER (WHERE r = 1) AS r1, count(*) FILTER (WHERE r = 2) AS r2 FROM (SELECT c_mktsegment, c_nationkey % 3 AS r FROM customer) GROUP BY 1")
def ag_10_crosstab(spark, d):
    df = table(spark, d, "customer").select("c_mktsegment", (F.col("c_nationkey") % 3).alias("r"))
    df = df.groupBy("c_mktsegment").pivot("r", [0, 1, 2]).agg(F.count(F.lit(1)))
    return df.select("c_mktsegment", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"r{i}") for i in range(3)])


@query("""SELECT user_id, CASE WHEN count(DISTINCT kind) = 0 THEN 'NOT_RECORDED' WHEN bool_or(kind = 'error') THEN 'AMBIGUOUS' WHEN count(DISTINCT kind) > 1 THEN 'MIXED' ELSE min(kind) END AS label,
  coalesce(string_agg(DISTINCT kind, ';' ORDER BY kind), '') AS kinds FROM (SELECT user_id, CASE WHEN value > 60 THEN event_type END AS kind FROM events) GROUP BY user_id""")
def ag_11_12_consensus_label(spark, d):
    df = table(spark, d, "events").select("user_id", F.when(F.col("value") > 60, F.col("event_type")).alias("kind"))
    df = df.groupBy("user_id").agg(F.sort_array(F.collect_set("kind")).alias("k"))
    label = F.when(F.size("k") == 0, "NOT_RECORDED").when(F.array_contains("k", "error"), "AMBIGUOUS").when(F.size("k") > 1, "MIXED").otherwise(F.get("k", F.lit(0)))
    return df.select("user_id", label.alias("label"), F.array_join("k", ";").alias("kinds"))


@query(f"""WITH {SQL_LINES} SELECT position, campaign, count(*) AS n, round(avg(reads), 6) AS mean_reads, grouping(position)::BIGINT AS all_positions, grouping(campaign)::BIGINT AS all_campaigns
  FROM lines GROUP BY GROUPING SETS ((), (position), (campaign))""")
def ag_14_grouping_sets(spark, d):
    df = lines(spark, d).groupingSets([[], [F.col("position")], [F.col("campaign")]], F.col("position"), F.col("campaign"))
    return df.agg(
        F.count("*").alias("n"), F.round(F.avg("reads"), 6).alias("mean_reads"), F.grouping("position").cast("long").alias("all_positions"), F.grouping("campaign").cast("long").alias("all_campaigns")
    )


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS largest FROM orders GROUP BY 1")
def ag_15_argmax_row(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest"))


@query(f"WITH {SQL_LINES} SELECT feature, split_part(sample, '_', 2) AS clean, round(avg(reads), 6) AS mean_reads FROM (SELECT feature, 'e' || (profile % 3)::VARCHAR || '_' || site::VARCHAR AS sample, sum(reads) AS reads FROM lines GROUP BY ALL) GROUP BY ALL")
def ag_17_mean_of_duplicates(spark, d):
    df = lines(spark, d).withColumn("sample", F.concat(F.lit("e"), (F.col("profile") % 3).cast("string"), F.lit("_"), F.col("site").cast("string")))
    df = df.groupBy("feature", "sample").agg(F.sum("reads").alias("reads"))
    return df.groupBy("feature", F.regexp_replace("sample", "^e[0-9]+_", "").alias("clean")).agg(F.round(F.avg("reads"), 6).alias("mean_reads"))


@query(f"""WITH {SQL_COUNTS} SELECT feature, round(count(*) FILTER (WHERE count > 0) / (SELECT count(*) FROM (SELECT DISTINCT campaign, site, position FROM counts)), 6) AS prevalence FROM counts GROUP BY feature""")
def ag_18_prevalence(spark, d):
    c = counts(spark, d)
    n = c.select("campaign", "site", "position").distinct().agg(F.count("*").alias("groups"))
    seen = c.groupBy("feature").agg(F.count_if(F.col("count") > 0).alias("seen"))
    return seen.crossJoin(F.broadcast(n)).select("feature", F.round(F.col("seen") / F.col("groups"), 6).alias("prevalence"))


@query(f"WITH {SQL_COUNTS} SELECT site, sum(count)::BIGINT AS total, round(sum(count * ln(count)), 5) AS c_log_c, count(*) FILTER (WHERE count > 0) AS nonzero FROM counts GROUP BY site")
def ag_19_one_pass_accumulators(spark, d):
    c = F.col("count")
    return counts(spark, d).groupBy("site").agg(F.sum(c).alias("total"), F.round(F.sum(c * F.log(c)), 5).alias("c_log_c"), F.count_if(c > 0).alias("nonzero"))


# --- sorts, sets, reshape ----------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders")
def so_1_multi_key_sort(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return o.select("o_orderkey", F.row_number().over(win.over(["year"], "o_orderpriority", F.desc_nulls_last("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query(f"""WITH {SQL_COUNTS}, rel AS (SELECT feature, count / sum(count) OVER (PARTITION BY campaign, site, position) AS p FROM counts)
  SELECT feature, round(sum(p) / (SELECT count(*) FROM (SELECT DISTINCT campaign, site, position FROM counts)), 6) AS mean_share FROM rel GROUP BY feature
  HAVING count(*) >= 0.2 * (SELECT count(*) FROM (SELECT DISTINCT campaign, site, position FROM counts)) ORDER BY mean_share DESC, feature LIMIT 10""")
def so_2_top_features(spark, d):
    from varve.operators.compose import closure

    c = counts(spark, d)
    n = c.select("campaign", "site", "position").distinct().agg(F.count("*").alias("groups"))
    p = c.withColumn("p", closure("count", ["campaign", "site", "position"])).groupBy("feature").agg(F.sum("p").alias("p"), F.count("*").alias("seen"))
    p = p.crossJoin(F.broadcast(n)).filter("seen >= 0.2 * groups").select("feature", F.round(F.col("p") / F.col("groups"), 6).alias("mean_share"))
    return p.orderBy(F.desc("mean_share"), "feature").limit(10)


@query(f"WITH {SQL_COUNTS} SELECT position, feature, total, row_number() OVER (PARTITION BY position ORDER BY total DESC, feature) AS place FROM (SELECT position, feature, sum(count)::BIGINT AS total FROM counts GROUP BY ALL) QUALIFY place <= 8")
def so_3_wn_5_top_per_group(spark, d):
    t = counts(spark, d).groupBy("position", "feature").agg(F.sum("count").alias("total"))
    return win.top_per_group(t, 8, ["position"], F.desc("total"), "feature").withColumn("place", F.col("place").cast("long"))


@query("SELECT p_name, sum(p_retailprice)::DOUBLE AS total FROM part GROUP BY 1 ORDER BY round(total, 4) DESC, p_name LIMIT 20")
def so_4_n_largest(spark, d):
    t = table(spark, d, "part").groupBy("p_name").agg(F.sum("p_retailprice").alias("total"))
    return t.orderBy(F.desc(F.round("total", 4)), "p_name").limit(20)


@query("SELECT n_name, place::BIGINT AS place FROM nation JOIN (VALUES ('AFRICA', 3), ('ASIA', 1), ('EUROPE', 2)) v(r, place) ON true JOIN region ON r_name = r AND n_regionkey = r_regionkey")
def so_5_external_order(spark, d):
    place = F.create_map(*[F.lit(x) for x in ("AFRICA", 3, "ASIA", 1, "EUROPE", 2)])[F.col("r_name")].cast("long")
    df = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.select("n_name", place.alias("place")).filter("place is not null").orderBy("place", "n_name")


@query("""SELECT 'supplier' AS role, s_nationkey::BIGINT AS nation, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customer', c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def st_1_union_by_name(spark, d):
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("role"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("role"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("""SELECT 'both' AS part, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
  UNION ALL SELECT 'only_f', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def st_2_3_5_intersect_except(spark, d):
    o = table(spark, d, "orders")
    f, p = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return f.intersect(p).select(F.lit("both").alias("part"), "k").union(f.subtract(p).select(F.lit("only_f").alias("part"), "k"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
  SELECT count(a.k) AS n_a, count(b.k) AS n_b, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, round(shared / count(*), 6) AS jaccard, round(shared / n_a, 6) AS a_in_b, round(shared / n_b, 6) AS b_in_a
  FROM a FULL JOIN b ON a.k = b.k""")
def st_4_set_overlap(spark, d):
    li = table(spark, d, "lineitem")
    a, b = (li.filter(F.col("l_returnflag") == s).select(F.col("l_partkey").alias("k")) for s in "AR")
    df = rel.overlap(a, b, "k")
    return df.select("n_a", "n_b", "shared", *[F.round(c, 6).alias(c) for c in ("jaccard", "a_in_b", "b_in_a")])


@query(f"WITH {SQL_LINES} SELECT site, sum(reads) FILTER (WHERE position = 'A')::BIGINT AS a, sum(reads) FILTER (WHERE position = 'N')::BIGINT AS n, sum(reads) FILTER (WHERE position = 'R')::BIGINT AS r FROM lines GROUP BY site")
def rs_1_pivot(spark, d):
    return lines(spark, d).groupBy("site").pivot("position", ["A", "N", "R"]).agg(F.sum("reads")).select("site", *[F.col(c).alias(c.lower()) for c in "ANR"])


@query("""SELECT c_custkey, metric, value FROM (SELECT c_custkey, c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer) UNPIVOT (value FOR metric IN (balance, nation))""")
def rs_2_unpivot(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return df.unpivot("c_custkey", ["balance", "nation"], "metric", "value")


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS building, (c_mktsegment = 'FURNITURE')::INT::DOUBLE AS furniture FROM customer")
def rs_3_one_hot(spark, d):
    df = rel.one_hot(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("s")), "s", ["AUTOMOBILE", "BUILDING", "FURNITURE"])
    return df.select("c_custkey", F.col("s_BUILDING").alias("building"), F.col("s_FURNITURE").alias("furniture"))


@query("""SELECT segment, priority, floor FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer), (SELECT DISTINCT o_orderpriority AS priority FROM orders), (SELECT event_type, round(quantile_cont(value, 0.5), 6) AS floor FROM events GROUP BY event_type)""")
def rs_4_parameter_grid(spark, d):
    """Every segment with every priority and the median of every event type: the levels come from the tables."""
    levels = lambda name, c, out: table(spark, d, name).select(F.col(c).alias(out)).distinct()
    floors = win.grouped_quantiles(table(spark, d, "events"), "value", {"floor": 0.5}, ["event_type"]).select(F.round("floor", 6).alias("floor"))
    return levels("customer", "c_mktsegment", "segment").crossJoin(levels("orders", "o_orderpriority", "priority")).crossJoin(floors)


@query("SELECT page_id, piece FROM (SELECT page_id, unnest(string_split(url, '/')) AS piece FROM pages) WHERE piece <> ''")
def rs_5_explode_delimited(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.split("url", "/")).alias("piece")).filter("piece <> ''")


@query(f"""WITH {SQL_DAILY}, rounded AS (SELECT site % 40 AS site, date, min(site) AS v FROM daily GROUP BY ALL),
  series AS (SELECT site, sha256(string_agg(date::VARCHAR || '=' || (v % 2)::VARCHAR, ';' ORDER BY date)) AS print FROM rounded GROUP BY site),
  firsts AS (SELECT site, min(site) OVER (PARTITION BY print) AS head FROM series)
  SELECT site, dense_rank() OVER (ORDER BY head) AS grid FROM firsts""")
def rs_6_series_fingerprint(spark, d):
    r = daily(spark, d).groupBy((F.col("site") % 40).alias("site"), "date").agg(F.min("site").alias("v"))
    piece = F.concat(F.col("date").cast("string"), F.lit("="), (F.col("v") % 2).cast("string"))
    s = r.groupBy("site").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(piece)), ";"), 256).alias("print"))
    s = s.withColumn("head", F.min("site").over(win.over(["print"])))
    return s.select("site", F.dense_rank().over(win.over([], "head")).cast("long").alias("grid"))


@query(f"""WITH {SQL_DAILY}, ends AS (SELECT site, min(date) AS a, max(date) AS b FROM daily GROUP BY site), days AS (SELECT site, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM ends)
  SELECT site, date FROM days ANTI JOIN daily USING (site, date)""")
def rs_7_calendar_gaps(spark, d):
    from varve.operators.exposure import calendar_gaps

    return calendar_gaps(daily(spark, d), "site", "date")
