"""The count data model on the fixture tables: profiles, pooled counts and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.session import table

#: One row for each order line as a read record; ``counts`` pools them.
SQL_LINES = """
lines AS (
  SELECT year(l_shipdate)::BIGINT AS campaign, s_nationkey::BIGINT AS site, l_returnflag AS position,
         p_brand AS feature, p_type AS kind, p_name AS label, l_suppkey AS profile, l_quantity::BIGINT AS reads
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
SQL_COUNTS = f"""{SQL_LINES},
counts AS (SELECT campaign, site, position, feature, sum(reads)::BIGINT AS count FROM lines GROUP BY ALL)"""
#: counts pooled to (site, position) by brand and type: about 150 features
SQL_SITES = f"""{SQL_LINES},
sites AS (SELECT site, position, feature, sum(reads)::BIGINT AS count FROM lines GROUP BY ALL)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_shipdate")
    su = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    pa = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    df = li.join(su, li.l_suppkey == su.s_suppkey).join(pa, li.l_partkey == pa.p_partkey)
    return df.select(
        F.year("l_shipdate").cast("long").alias("campaign"),
        F.col("s_nationkey").cast("long").alias("site"),
        F.col("l_returnflag").alias("position"),
        F.col("p_brand").alias("feature"),
        F.col("p_type").alias("kind"),
        F.col("p_name").alias("label"),
        F.col("l_suppkey").alias("profile"),
        F.col("l_quantity").cast("long").alias("reads"),
    )


def counts(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("campaign", "site", "position", "feature").agg(F.sum("reads").alias("count"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("site", "position", "feature").agg(F.sum("reads").alias("count"))


#: Events as a daily series: one row for each (user, day) with activity.
SQL_DAILY = """
daily AS (SELECT user_id AS site, ts::DATE AS date, sum(value) AS mm FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
visits AS (SELECT event_id AS visit, user_id AS site, ts::DATE AS date FROM events WHERE event_type = 'purchase')"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").filter("event_type <> 'purchase'")
    return ev.groupBy(F.col("user_id").alias("site"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("mm"))


def visits(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").filter("event_type = 'purchase'")
    return ev.select(F.col("event_id").alias("visit"), F.col("user_id").alias("site"), F.to_date("ts").alias("date"))
