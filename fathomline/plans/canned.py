"""The console's canned questions as SQL over the tables' views, run by spark.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.metrics import co_occurrence
from fathomline.plans.define import Plans, Tables
from fathomline.sources.catalog import Catalog

PLANS = Plans()

#: name: SQL that Spark and DuckDB both run.
CANNED = {
    "canned_facilities_by_type": "SELECT c_mktsegment AS facility_type, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, facility_type",
    "canned_top_networks": "SELECT r_name AS network, count(*) AS facilities FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY facilities DESC, network",
    "canned_hot_areas": "SELECT p_brand AS area, count(DISTINCT l_suppkey) AS facilities FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY facilities DESC, area LIMIT 25",
    "canned_facilities_per_country": "SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, country",
    "canned_regions_per_network": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "canned_facilities_inside": "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 5000",
    "canned_funders_leaderboard": "SELECT s_name AS funder, count(*) AS events, count(DISTINCT l_partkey) AS facilities FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY events DESC, funder LIMIT 20",
    "canned_funding_by_year": "SELECT CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, round(sum(l_extendedprice), 2) AS usd, count(*) AS n FROM lineitem GROUP BY year(l_shipdate)",
    "canned_key_personnel": "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderdate > timestamp '2000-01-01 00:00:00'",
    "canned_top_researchers": "SELECT c.c_name AS person, count(DISTINCT o_orderkey) AS works, count(DISTINCT l_suppkey) AS facilities FROM customer c LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c.c_name ORDER BY works DESC, person LIMIT 500",
    "canned_person_areas": "SELECT l_suppkey AS person, p_brand AS area, round(sum(l_discount), 3) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand HAVING sum(l_discount) > 1.2005",
    "canned_top_collaborations": "WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.s_name AS a, z.s_name AS b, count(*) AS n FROM m p JOIN m q ON p.l_orderkey = q.l_orderkey AND p.l_suppkey < q.l_suppkey LEFT JOIN supplier x ON p.l_suppkey = x.s_suppkey LEFT JOIN supplier z ON q.l_suppkey = z.s_suppkey GROUP BY x.s_name, z.s_name ORDER BY n DESC, a, b LIMIT 50",
    "canned_verdicts_by_day": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY event_type, CAST(ts AS DATE)",
}


def _runner(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Catalog(spark, sf_dir).sql(sql)

    return run


for _name, _sql in CANNED.items():
    PLANS.queries[_name], PLANS.oracles[_name] = _runner(_sql), _sql


def _top_collaborations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canned question by pairs of keys, made by as many tasks as the lines ask for; names that several keys have are added up."""
    t = Tables(spark, sf_dir)
    pairs = co_occurrence(t.lineitem.select("l_orderkey", "l_suppkey", F.lit(0).alias("y")), "l_orderkey", "l_suppkey", "y").select("a", "b", "n")
    name = lambda end: t.supplier.select(F.col("s_suppkey").alias(f"__{end}"), F.col("s_name").alias(f"{end}_name"))
    named = pairs.join(name("a"), F.col("a") == F.col("__a"), "left").join(name("b"), F.col("b") == F.col("__b"), "left")
    out = named.groupBy(F.col("a_name").alias("a"), F.col("b_name").alias("b")).agg(F.sum("n").alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_last("a"), F.asc_nulls_last("b")).limit(50)


PLANS.queries["canned_top_collaborations"] = _top_collaborations
