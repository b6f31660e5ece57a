"""String, identifier, date, geometry and sequence functions over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.functions import ids
from varve.session import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_ID = "s AS (SELECT s_suppkey, ['', 'T', 'F', 'S', 'V'][s_suppkey % 5 + 1] || s_nationkey::VARCHAR || ['S', 'D', 'PR', 'x'][s_suppkey % 4 + 1] || 'r' || (s_suppkey % 3)::VARCHAR AS id FROM supplier)"


def _id(spark, d):
    k = F.col("s_suppkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", F.concat(pick(["", "T", "F", "S", "V"]), F.col("s_nationkey").cast("string"), pick(["S", "D", "PR", "x"]), F.lit("r"), (k % 3).cast("string")).alias("id"))


@query(f"""WITH {_ID}, m AS (SELECT *, regexp_matches(id, '^([TFSV])?([0-9]+)(PR|P|D|S)r([0-9]+)') AS ok FROM s)
  SELECT s_suppkey, id, CASE WHEN ok THEN CASE regexp_extract(id, '^[TFSV]') WHEN '' THEN 1 WHEN 'T' THEN 2 WHEN 'F' THEN 3 WHEN 'S' THEN 4 ELSE 5 END END AS campaign,
   CASE WHEN ok THEN regexp_extract(id, '[0-9]+')::INTEGER END AS site, CASE WHEN ok THEN CASE WHEN id LIKE '%PRr%' THEN 'Rhizosphere' WHEN id LIKE '%Dr%' THEN 'Deep' ELSE 'Surface' END END AS position FROM m""")
def sc_1_cx_8_sample_id(spark, d):
    p = ids.sample_id(F.col("id"))
    return _id(spark, d).withColumn("p", p).select("s_suppkey", "id", "p.campaign", "p.site", "p.position")


@query("""SELECT p_partkey, nullif(trim(split_part(l, ';', 1)), 'NA') AS kingdom, nullif(trim(split_part(l, ';', 2)), '') AS phylum, trim(split_part(l, ';', 3)) AS class,
  CASE WHEN p_partkey % 2 = 0 THEN 'g__' || p_brand ELSE 'g__' END AS genus FROM (SELECT *, concat_ws(';', CASE WHEN p_partkey % 3 = 0 THEN 'NA' ELSE p_type END, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_brand END, ' ' || p_name) AS l FROM part)""")
def sc_2_3_lineage(spark, d):
    k = F.col("p_partkey")
    text = F.concat_ws(";", F.when(k % 3 == 0, "NA").otherwise(F.col("p_type")), F.when(k % 4 == 0, " ").otherwise(F.col("p_brand")), F.concat(F.lit(" "), "p_name"))
    tag = F.concat(F.lit("d__Bacteria; p__x"), F.when(k % 2 == 0, F.concat(F.lit("; g__"), F.col("p_brand"))).otherwise(F.lit("")))
    df = table(spark, d, "part").select("p_partkey", ids.lineage(text).alias("l"), ids.tagged_lineage(tag).alias("t"))
    return df.select("p_partkey", "l.kingdom", "l.phylum", "l.class", "t.genus")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'unclassified_singleton::' || p_name ELSE p_brand END AS grp FROM part")
def sc_4_singleton_groups(spark, d):
    g = F.when(F.col("p_size") % 4 == 0, F.lit(" g__ ")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", ids.group_or_singleton(g, F.col("p_name")).alias("grp"))


@query("""SELECT page_id, regexp_replace(url, '^https?://(m[.]|blog[.])?', '') AS bare, lower(regexp_extract(url, '//([^/]+)', 1)) AS host, url LIKE '%example%' AS example, starts_with(url, 'https') AS secure,
  CASE WHEN url LIKE '%+' THEN 'pos' ELSE regexp_replace(url, '[^A-Za-z0-9]', '', 'g') END AS label FROM pages""")
def sc_5_string_functions(spark, d):
    u = F.col("url")
    label = F.when(u.endswith("+"), "pos").otherwise(F.regexp_replace(u, "[^A-Za-z0-9]", ""))
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_replace(u, "^https?://(m[.]|blog[.])?", "").alias("bare"),
        F.lower(F.regexp_extract(u, "//([^/]+)", 1)).alias("host"),
        u.contains("example").alias("example"),
        u.startswith("https").alias("secure"),
        label.alias("label"),
    )


@query("SELECT s_suppkey, (s_suppkey % 8)::BIGINT AS row, (1 + s_suppkey % 12)::BIGINT AS col FROM supplier")
def sc_6_well_position(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.char(65 + k % 8), (1 + k % 12).cast("string"))
    w = table(spark, d, "supplier").select("s_suppkey", ids.well(name).alias("w"))
    return w.select("s_suppkey", F.col("w.row").cast("long").alias("row"), F.col("w.column").cast("long").alias("col"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, o_orderdate::DATE AS parsed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS coerced FROM orders""")
def sc_7_date_parse_format(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "dd/MM/yyyy"))
    bad = F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(F.col("day"))
    parse = lambda c: F.to_date(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")))
    return o.select("o_orderkey", "day", parse(F.col("day")).alias("parsed"), parse(bad).alias("coerced"))


@query("SELECT o_orderkey, (o_orderdate::DATE - k::INT)::DATE AS needed, k AS lag FROM orders, range(1, 5) r(k)")
def sc_8_required_dates(spark, d):
    o = table(spark, d, "orders").withColumn("lag", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    return o.select("o_orderkey", F.date_sub(F.to_date("o_orderdate"), F.col("lag").cast("int")).alias("needed"), "lag")


@query("""SELECT o_orderkey, (year(o_orderdate) + (month(o_orderdate) = 12)::INT)::BIGINT AS season, CASE WHEN year(o_orderdate) + (month(o_orderdate) = 12)::INT = 1997
  THEN make_date(2001 - (month(o_orderdate) = 12)::INT, month(o_orderdate), day(o_orderdate)) END AS remapped FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""")
def sc_9_season_remap(spark, d):
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").filter(~((F.month("o_orderdate") == 2) & (F.day("o_orderdate") == 29)))
    return o.select("o_orderkey", ids.meteorological_year(day).cast("long").alias("season"), ids.remapped_date(day, {1997: 2001}).alias("remapped"))


@query("SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 9) AS l, round(log10(1 + abs(c_acctbal)), 9) AS l10, round(sqrt(abs(c_acctbal)), 9) AS r, floor(c_acctbal)::BIGINT AS f, sign(c_acctbal)::BIGINT AS s, round_even(c_acctbal, 0)::BIGINT AS e FROM customer")
def sc_10_math_functions(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.round(F.log1p(F.abs(x)), 9).alias("l"), F.round(F.log10(1 + F.abs(x)), 9).alias("l10"), F.round(F.sqrt(F.abs(x)), 9).alias("r"), F.floor(x).alias("f"), F.signum(x).cast("long").alias("s"), F.rint(x).cast("long").alias("e")
    )


_GEO = "geo AS (SELECT n_nationkey AS k, 18 + 0.3::DOUBLE * n_nationkey AS lat, 45 + 0.5::DOUBLE * n_nationkey AS lon FROM nation)"


def _geo(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("k"), (18 + 0.3 * k).alias("lat"), (45 + 0.5 * k).alias("lon"))


@query(f"""WITH {_GEO}, p AS (SELECT a.k AS i, b.k AS j, 12742 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) AS km FROM geo a JOIN geo b ON a.k < b.k)
  SELECT i, j, round(km, 6) AS km, round(exp(-km / 50), 9) AS e, round((1 + sqrt(3) * km / 50) * exp(-sqrt(3) * km / 50), 9) AS m32, round((1 + sqrt(5) * km / 50 + 5 * km * km / 2500 / 3) * exp(-sqrt(5) * km / 50), 9) AS m52 FROM p""")
def sc_11_15_haversine_kernels(spark, d):
    from varve.operators.relational import pairs

    p = pairs(_geo(spark, d), "k", cols=["lat", "lon"])
    p = p.withColumn("km", ids.haversine(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")))
    kern = lambda kind: F.round(ids.covariance_kernel(F.col("km"), kind, 50), 9)
    return p.select(F.col("k_i").alias("i"), F.col("k_j").alias("j"), F.round("km", 6).alias("km"), kern("exponential").alias("e"), kern("matern32").alias("m32"), kern("matern52").alias("m52"))


@query(f"""WITH {_GEO}, g AS (SELECT k, lat + (k * 7 % 5) AS lat, lon + (k * 3 % 4) AS lon FROM geo), m AS (SELECT avg(lat) AS a, avg(lon) AS o FROM g),
  xy AS (SELECT k, (lon - o) * 111.320 * cos(radians(a)) AS x, (lat - a) * 110.574 AS y FROM g, m), t AS (SELECT 0.5 * atan2(2 * sum(x * y), sum(x * x) - sum(y * y)) AS theta FROM xy)
  SELECT k, round(x, 6) AS x_km, round(y, 6) AS y_km, round((x * cos(theta) + y * sin(theta)) * sign(cos(theta)), 6) AS transect_km FROM xy, t""")
def sc_12_transect_projection(spark, d):
    from varve.operators.spatial import transect

    k = F.col("k")
    g = _geo(spark, d).select("k", (F.col("lat") + (k * 7 % 5)).alias("lat"), (F.col("lon") + (k * 3 % 4)).alias("lon"))
    df = transect(g, "lat", "lon")
    return df.select("k", *[F.round(c, 6).alias(c) for c in ("x_km", "y_km", "transect_km")])


_DNA = "dna AS (SELECT p_partkey, upper(translate(substr(md5(p_name || p_partkey::VARCHAR), 1, 12 + p_partkey % 3), '0123456789abcdef', 'ACGTACGTACGTACGT')) AS seq FROM part)"


def _dna(spark, d):
    h = F.substring(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))), F.lit(1), (12 + F.col("p_partkey") % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.upper(F.translate(h, "0123456789abcdef", "ACGTACGTACGTACGT")).alias("seq"))


_CODONS = ", ".join(f"'{a + b + c}': '{ids.TABLE_11[16 * i + 4 * j + k]}'" for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG"))


@query(f"""WITH {_DNA}, aa AS (SELECT p_partkey, seq, list_aggregate(list_transform(range(0, length(seq) // 3), lambda i: MAP {{{_CODONS}}}[substr(seq, 1 + 3 * i, 3)]), 'string_agg', '') AS raw FROM dna),
  p AS (SELECT *, regexp_replace(CASE WHEN p_partkey % 2 = 0 AND substr(seq, 1, 3) IN ('TTG', 'CTG', 'ATT', 'ATC', 'ATA', 'ATG', 'GTG') THEN 'M' || substr(raw, 2) ELSE raw END, '[*]$', '') AS pr, length(seq) % 3 = 0 AS ok FROM aa)
  SELECT p_partkey, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, CASE WHEN ok THEN 'ok' ELSE 'length_not_multiple_of_three' END AS status, CASE WHEN ok THEN pr END AS protein,
   CASE WHEN ok THEN length(pr) - length(replace(pr, '*', '')) END AS internal_stops FROM p""")
def sc_16_17_translation(spark, d):
    df = _dna(spark, d).withColumn("t", ids.translate_cds(F.col("seq"), F.col("p_partkey") % 2 == 0))
    return df.select("p_partkey", ids.reverse_complement(F.col("seq")).alias("rc"), "t.status", "t.protein", F.col("t.internal_stops").cast("long").alias("internal_stops"))


@query("""WITH a AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'MK*' WHEN 1 THEN 'M*K' WHEN 2 THEN 'M K' WHEN 3 THEN NULL ELSE 'MKV' END AS aa FROM part)
  SELECT p_partkey, CASE WHEN aa IS NULL THEN 'missing' WHEN aa LIKE '% %' THEN 'whitespace' WHEN regexp_replace(aa, '[*]$', '') LIKE '%*%' THEN 'internal_stop' ELSE 'ok' END AS status,
   CASE WHEN p_partkey % 5 = 0 THEN 'MK' WHEN p_partkey % 5 = 4 THEN 'MKV' END AS sequence FROM a""")
def sc_18_protein_cleaning(spark, d):
    aa = F.element_at(F.array(F.lit("MK*"), F.lit("M*K"), F.lit("M K"), F.lit(None).cast("string"), F.lit("MKV")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", ids.clean_protein(aa).alias("c")).select("p_partkey", "c.status", "c.sequence")


@query(f"""WITH {_DNA} SELECT a.p_partkey, substr(b.seq, 4, 6) = substr(a.seq, 1, 6) AS agrees, 9 <= length(b.seq) AS in_bounds FROM dna a JOIN dna b ON b.p_partkey = a.p_partkey // 2""")
def sc_19_locus_check(spark, d):
    a = _dna(spark, d)
    b = a.select(F.col("p_partkey").alias("k"), F.col("seq").alias("contig"))
    df = a.join(b, F.floor(F.col("p_partkey") / 2) == F.col("k"))
    return df.select("p_partkey", (F.substring("contig", 4, 6) == F.substring("seq", 1, 6)).alias("agrees"), (F.length("contig") >= 9).alias("in_bounds"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE starts_with(text, 'The')) AS starts, count(*) FILTER (WHERE regexp_matches(text, 'tion[a-z]{0,3}er')) AS pattern FROM documents GROUP BY lang")
def sc_21_pattern_counters(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(t.startswith("The")).alias("starts"), F.count_if(t.rlike("tion[a-z]{0,3}er")).alias("pattern"))


@query("""SELECT event_type, CASE WHEN n IS NULL OR n < 5 THEN 'UNAVAILABLE' WHEN m > 26 THEN 'SUPPORTED' WHEN m > 24 THEN 'INCONCLUSIVE' ELSE 'NOT_SUPPORTED' END AS verdict FROM (SELECT event_type, count(value) AS n, avg(value) AS m FROM events GROUP BY 1)""")
def sc_22_cx_28_verdict_ladder(spark, d):
    df = table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    verdict = F.when(F.col("n").isNull() | (F.col("n") < 5), "UNAVAILABLE").when(F.col("m") > 26, "SUPPORTED").when(F.col("m") > 24, "INCONCLUSIVE").otherwise("NOT_SUPPORTED")
    return df.select("event_type", verdict.alias("verdict"))


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '":' || n::VARCHAR, ',' ORDER BY event_type) || '}' AS doc FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def sc_23_json_map(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    n = n.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("e"))
    return n.select("user_id", F.to_json(F.map_from_entries("e")).alias("doc"))


@query("""SELECT page_id, CASE WHEN regexp_matches(k, '^[0-9]+$') THEN 'canonical_numeric_site' WHEN k IN ('theres', 'ththha') THEN 'canonical_named_site' WHEN k LIKE 'th%' THEN 'near_site_annotation' WHEN k LIKE '%-%' THEN 'free_text_location' ELSE 'unclassified' END AS class
  FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN page_id::VARCHAR ELSE regexp_extract(url, '//(?:blog[.]|m[.])?([a-z-]+)[.]', 1) END AS k FROM pages)""")
def cx_4_key_resolution(spark, d):
    k = F.when(F.col("page_id") % 5 == 0, F.col("page_id").cast("string")).otherwise(F.regexp_extract("url", "//(?:blog[.]|m[.])?([a-z-]+)[.]", 1))
    df = table(spark, d, "pages").select("page_id", k.alias("k"))
    known = F.broadcast(spark.range(1).select(F.explode(F.array(F.lit("theres"), F.lit("ththha"))).alias("name")))
    df = df.join(known, F.col("k") == F.col("name"), "left")
    label = (
        F.when(F.col("k").rlike("^[0-9]+$"), "canonical_numeric_site")
        .when(F.col("name").isNotNull(), "canonical_named_site")
        .when(F.col("k").startswith("th"), "near_site_annotation")
        .when(F.col("k").contains("-"), "free_text_location")
        .otherwise("unclassified")
    )
    return df.select("page_id", label.alias("class"))


@query("SELECT user_id, count(DISTINCT event_type) AS features, round(sum(value), 4) AS total FROM events WHERE regexp_matches(event_type, '^e') GROUP BY user_id")
def cx_5_control_load(spark, d):
    df = table(spark, d, "events").filter(F.col("event_type").rlike("^e"))
    return df.groupBy("user_id").agg(F.countDistinct("event_type").alias("features"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH c AS (SELECT DISTINCT md5(p_name) AS h FROM part WHERE p_type LIKE '%STEEL%') SELECT p_brand, count(*) AS n, count(c.h) AS hits, round(count(c.h) / count(*), 6) AS prevalence FROM part LEFT JOIN c ON md5(p_name) = c.h GROUP BY p_brand""")
def cx_6_control_characterisation(spark, d):
    p = table(spark, d, "part")
    c = p.filter("p_type like '%STEEL%'").select(F.md5("p_name").alias("h")).distinct()
    df = p.join(c, F.md5("p_name") == F.col("h"), "left")
    return df.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("h").alias("hits"), F.round(F.count("h") / F.count("*"), 6).alias("prevalence"))


@query("""SELECT page_id, regexp_extract(url, 'example[.]([a-z]+)', 1) AS family, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number, regexp_extract(url, '^([a-z]+)', 1) AS lane FROM pages""")
def cx_7_index_name(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(u, "example[.]([a-z]+)", 1).alias("family"), F.regexp_extract(u, "/([0-9]+)", 1).try_cast("long").alias("number"), F.regexp_extract(u, "^([a-z]+)", 1).alias("lane")
    )


@query("""WITH n AS (SELECT c_custkey // 2 AS pair, CASE WHEN c_custkey % 2 = 0 THEN 'T' ELSE 'UT' END AS arm, c_acctbal FROM customer WHERE c_custkey % 7 <> 0) SELECT pair, max(c_acctbal) FILTER (WHERE arm = 'T') AS treated, max(c_acctbal) FILTER (WHERE arm = 'UT') AS untreated FROM n GROUP BY pair HAVING count(*) = 2""")
def cx_9_pairing_by_id(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").filter(k % 7 != 0).withColumn("id", F.concat(F.floor(k / 2).cast("string"), F.when(k % 2 == 0, "T").otherwise("UT")))
    parts = lambda i: F.regexp_extract("id", "^([0-9]+)(T|UT)$", i)
    c = c.select(parts(1).cast("long").alias("pair"), parts(2).alias("arm"), "c_acctbal")
    w = c.groupBy("pair").pivot("arm", ["T", "UT"]).agg(F.max("c_acctbal")).dropna()
    return w.select("pair", F.col("T").alias("treated"), F.col("UT").alias("untreated"))
