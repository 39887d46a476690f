"""Funding queries: line items stand in for funding events, suppliers for funders, parts for facilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import fiscal_year
from fathomline.operators.keys import top_per_group
from fathomline.operators.metrics import coverage
from fathomline.operators.nested import joined_set
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query


@query("""
SELECT s_suppkey AS funder_id, s_name AS funder, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
       round(sum(l_extendedprice), 2) AS total_usd, count(*) AS event_count, count(DISTINCT l_partkey) AS facility_count
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL
GROUP BY ALL
""")
def funder_funding_by_year(t: Tables) -> DataFrame:
    events = t.lineitem.where("l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL")
    per_funder = events.groupBy("l_suppkey", F.year("l_shipdate").alias("fiscal_year")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total_usd"),
        F.count("*").alias("event_count"),
        F.countDistinct("l_partkey").alias("facility_count"),
    )
    return per_funder.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("funder_id"), F.col("s_name").alias("funder"),
        "fiscal_year", "total_usd", "event_count", "facility_count",
    )


@query("""
SELECT l_partkey AS facility_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
       round(sum(l_extendedprice), 2) AS total_usd, count(*) AS event_count,
       string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '|' ORDER BY CAST(l_suppkey AS VARCHAR)) AS funders
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL
""")
def facility_funding_by_year(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate IS NOT NULL").groupBy(
        F.col("l_partkey").alias("facility_id"), F.year("l_shipdate").alias("fiscal_year")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("total_usd"), F.count("*").alias("event_count"), joined_set("l_suppkey").alias("funders"))


@query("""
SELECT l_orderkey AS award, l_linenumber AS line, p_name AS facility, s_name AS funder, n_name AS country,
       CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, l_extendedprice AS amount_usd
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
""")
def funding_ledger(t: Tables) -> DataFrame:
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_orderkey").alias("award"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("facility"),
            F.col("s_name").alias("funder"), F.col("n_name").alias("country"), F.year("l_shipdate").alias("fiscal_year"),
            F.col("l_extendedprice").alias("amount_usd"),
        )
    )


#: An illustrative yearly price index; its last year is the anchor.
PRICE_INDEX = ((1995, 152.4), (1996, 156.9), (1997, 160.5), (1998, 163.0), (1999, 166.6), (2000, 172.2), (2001, 177.1), (2002, 179.9))
_INDEX_SQL = ", ".join(f"({y}, {v}e0)" for y, v in PRICE_INDEX)


@query(f"""
WITH cpi(y, v) AS (VALUES {_INDEX_SQL}), f AS (
  SELECT l_suppkey AS funder_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, sum(l_extendedprice) AS usd FROM lineitem GROUP BY ALL
)
SELECT funder_id, fiscal_year, round(usd, 2) AS nominal_usd, round(usd * (SELECT v FROM cpi WHERE y = 2002) / v, 2) AS real_usd
FROM f LEFT JOIN cpi ON fiscal_year = y
""")
def funding_real(t: Tables) -> DataFrame:
    index = t.spark.sql(f"SELECT y, CAST(v AS DOUBLE) AS v FROM VALUES {_INDEX_SQL} AS c(y, v)")
    anchor = index.where("y = 2002").select(F.col("v").alias("anchor"))
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("funder_id"), F.year("l_shipdate").alias("fiscal_year")).agg(F.sum("l_extendedprice").alias("usd"))
    joined = sums.join(F.broadcast(index), F.col("fiscal_year") == F.col("y"), "left").crossJoin(F.broadcast(anchor))
    return joined.select("funder_id", "fiscal_year", F.round("usd", 2).alias("nominal_usd"), F.round(F.col("usd") * F.col("anchor") / F.col("v"), 2).alias("real_usd"))


@query("""
SELECT o_custkey AS recipient, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
       round(sum(o_totalprice), 2) AS amount, arg_min(o_orderpriority, o_orderkey) AS first_agency,
       min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM orders WHERE o_totalprice <> 0 GROUP BY ALL
""")
def fiscal_year_rollup(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice <> 0").groupBy(
        F.col("o_custkey").alias("recipient"), fiscal_year("o_orderdate").alias("fiscal_year")
    ).agg(
        F.round(F.sum("o_totalprice"), 2).alias("amount"), F.min_by("o_orderpriority", "o_orderkey").alias("first_agency"),
        F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
    )


_AREA_SQL = """
WITH e AS (SELECT p_brand AS area, l_suppkey AS funder_id, l_extendedprice AS usd, CAST(year(l_shipdate) AS INTEGER) AS fy
           FROM lineitem JOIN part ON l_partkey = p_partkey WHERE coalesce(l_returnflag, '') <> 'R'),
by_funder AS (SELECT area, funder_id, sum(usd) AS usd FROM e GROUP BY ALL),
top AS (SELECT * FROM by_funder QUALIFY row_number() OVER (PARTITION BY area ORDER BY round(usd, 2) DESC, funder_id) = 1)
"""


def _area_events(t: Tables) -> DataFrame:
    return t.lineitem.where("coalesce(l_returnflag, '') <> 'R'").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("area"), F.col("l_suppkey").alias("funder_id"), F.col("l_extendedprice").alias("usd"), F.year("l_shipdate").alias("fy")
    )


@query(_AREA_SQL + """
SELECT e.area, count(*) AS events, round(sum(e.usd), 2) AS total_usd, count(DISTINCT e.funder_id) AS funders,
       min(fy) AS first_fy, max(fy) AS last_fy, any_value(top.funder_id) AS top_funder
FROM e JOIN top USING (area) GROUP BY e.area
""")
def area_funding_top1(t: Tables) -> DataFrame:
    by_funder = _area_events(t).groupBy("area", "funder_id").agg(
        F.sum("usd").alias("usd"), F.count("*").alias("n"), F.min("fy").alias("a"), F.max("fy").alias("b")
    )
    top = top_per_group(by_funder.withColumn("r", F.round("usd", 2)), "area", [F.desc("r"), F.asc("funder_id")]).select("area", F.col("funder_id").alias("top_funder"))
    return by_funder.groupBy("area").agg(
        F.sum("n").alias("events"), F.round(F.sum("usd"), 2).alias("total_usd"), F.count("funder_id").alias("funders"),
        F.min("a").alias("first_fy"), F.max("b").alias("last_fy"),
    ).join(top, "area")


@query(_AREA_SQL + "SELECT area, funder_id, count(*) AS events, round(sum(usd), 2) AS total_usd FROM e GROUP BY ALL")
def area_funder_rollup(t: Tables) -> DataFrame:
    return _area_events(t).groupBy("area", "funder_id").agg(F.count("*").alias("events"), F.round(F.sum("usd"), 2).alias("total_usd"))


_COVERAGE_SQL = " UNION ALL ".join(
    f"SELECT p_brand AS area, '{f}' AS facet, CAST({f} AS VARCHAR) AS value, count(DISTINCT s_suppkey) AS n FROM base GROUP BY ALL"
    for f in ("n_name", "r_name", "p_type")
)
_COVERAGE_BASE = """WITH base AS (SELECT DISTINCT p_brand, p_type, s_suppkey, n_name, r_name FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) """


def _coverage_base(t: Tables) -> DataFrame:
    links = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_type", "l_suppkey").distinct()
    places = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return links.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("area"), "p_type", "s_suppkey", "n_name", "r_name")


@query(_COVERAGE_BASE + _COVERAGE_SQL)
def coverage_matrix(t: Tables) -> DataFrame:
    return coverage(_coverage_base(t), "area", ("n_name", "r_name", "p_type"), "s_suppkey")


@query(_COVERAGE_BASE + """
SELECT p_brand AS area, n_name, r_name, p_type, count(DISTINCT s_suppkey) AS n FROM base
GROUP BY GROUPING SETS ((p_brand, n_name), (p_brand, r_name), (p_brand, p_type))
""")
def coverage_grouping_sets(t: Tables) -> DataFrame:
    f = {c: F.col(c) for c in ("area", "n_name", "r_name", "p_type")}
    sets = [[f["area"], f["n_name"]], [f["area"], f["r_name"]], [f["area"], f["p_type"]]]
    return _coverage_base(t).groupingSets(sets, *f.values()).agg(F.countDistinct("s_suppkey").alias("n"))


@query("""
WITH per AS (SELECT l_suppkey, sum(l_extendedprice) AS usd FROM lineitem GROUP BY ALL)
SELECT c_custkey AS person, round(sum(usd), 2) AS funding_base, count(*) AS roles
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN per USING (l_suppkey) GROUP BY ALL
""")
def person_funding_base(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("usd"))
    roles = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    counted = roles.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    return counted.join(per, "l_suppkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("person")).agg(
        F.round(F.sum(F.col("usd") * F.col("n")), 2).alias("funding_base"), F.sum("n").alias("roles")
    )
