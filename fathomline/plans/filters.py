"""Facet filters, semi and anti joins, set operations, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.predicates import Facets, band, haystack, outside_boxes
from fathomline.operators.sorting import by, page, rank_of, record_tier
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey IN (1, 2, 3, 16)
AND c_acctbal IS NOT NULL AND c_acctbal BETWEEN 0 AND 5000 AND contains(lower(c_name), 'customer#0000001')
AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P'))
""")
def facet_filter_all(t: Tables) -> DataFrame:
    links = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    state = Facets(
        values={"c_mktsegment": ["MACHINERY", "FURNITURE"], "c_nationkey": [1, 2, 3, 16]}, ranges={"c_acctbal": (0, 5000)},
        linked={"c_custkey": (links, "o_orderstatus", ["O", "P"])}, text="Customer#0000001", text_columns=("c_name",),
    )
    return state.apply(t.customer).select("c_custkey", "c_name")


@query("""
SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag IN ('A'))
AND s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2'))
""")
def facet_semi_areas(t: Tables) -> DataFrame:
    flags = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
    areas = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), "p_brand")
    held = Facets(linked={"s_suppkey": (flags, "l_returnflag", ["A"])}).apply(t.supplier)
    return Facets(linked={"s_suppkey": (areas, "p_brand", ["Brand#1", "Brand#2"])}).apply(held).select("s_suppkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))")
def facet_range_text(t: Tables) -> DataFrame:
    return Facets(ranges={"p_size": (5, 20)}, text=" RING ", text_columns=("p_name", "p_type")).apply(t.part).select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM customer")
def facet_empty(t: Tables) -> DataFrame:
    return Facets(values={"c_mktsegment": []}).apply(t.customer).agg(F.count("*").alias("n"))


@query("""
WITH pts AS (SELECT c_custkey, c_nationkey % 3 AS g, c_custkey * 7 % 180 - 90 AS lat, c_custkey * 13 % 360 - 180 AS lng FROM customer)
SELECT c_custkey FROM pts WHERE g < 2 AND NOT ((g = 0 AND lng BETWEEN -50 AND 50 AND lat BETWEEN -30 AND 30)
  OR (g = 0 AND lng BETWEEN 100 AND 170 AND lat BETWEEN 0 AND 60) OR (g = 1 AND lng BETWEEN -180 AND 0 AND lat BETWEEN -90 AND 90))
""")
def bbox_outside(t: Tables) -> DataFrame:
    points = t.customer.selectExpr("c_custkey", "c_nationkey % 3 AS g", "c_custkey * 7 % 180 - 90 AS lat", "c_custkey * 13 % 360 - 180 AS lng")
    boxes = t.spark.sql("SELECT * FROM VALUES (0, -50, 50, -30, 30), (0, 100, 170, 0, 60), (1, -180, 0, -90, 90) AS b(g, x0, x1, y0, y1)")
    return outside_boxes(points, boxes, "g", "lng", "lat").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'widget brand#1')")
def haystack_search(t: Tables) -> DataFrame:
    return t.part.where(haystack("Widget Brand#1", ("p_name", "p_brand", "p_type"))).select("p_partkey")


@query("""
SELECT CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band,
       count(*) AS n FROM customer GROUP BY ALL
""")
def banded_balances(t: Tables) -> DataFrame:
    label = band(F.col("c_acctbal"), ((0, "debt"), (1000, "low"), (5000, "middle")), "high", "unknown")
    return t.customer.groupBy(label.alias("band")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def anti_not_in(t: Tables) -> DataFrame:
    pending = t.orders.where("o_orderstatus = 'P' AND o_custkey IS NOT NULL")
    return t.customer.join(pending, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 WHERE l_orderkey IS NULL")
def anti_is_null(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("""
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'
AND (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')
""")
def tuple_anti(t: Tables) -> DataFrame:
    keys = ["l_partkey", "l_suppkey"]
    return t.lineitem.where("l_returnflag = 'A'").select(*keys).distinct().join(t.lineitem.where("l_returnflag = 'N'").select(*keys), keys, "left_anti")


@query("SELECT o_custkey AS node FROM orders UNION ALL SELECT l_suppkey FROM lineitem")
def union_endpoints(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("node")).unionByName(t.lineitem.select(F.col("l_suppkey").alias("node")))


@query("SELECT o_custkey AS node FROM orders UNION SELECT l_suppkey FROM lineitem")
def union_distinct(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("node")).union(t.lineitem.select("l_suppkey")).distinct()


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT l_suppkey FROM lineitem)
UNION ALL SELECT 'orders only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT l_suppkey FROM lineitem)
""")
def except_intersect(t: Tables) -> DataFrame:
    a, b = t.orders.select("o_custkey"), t.lineitem.select("l_suppkey")
    n = F.count("*").alias("n")
    return a.intersect(b).agg(n).select(F.lit("both").alias("side"), "n").unionByName(a.subtract(b).agg(n).select(F.lit("orders only").alias("side"), "n"))


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_size END DESC NULLS LAST, p_partkey) AS place FROM part
QUALIFY place <= 50
""")
def sort_nulls_last(t: Tables) -> DataFrame:
    sized = t.part.withColumn("s", F.when(F.col("p_size") <= 40, F.col("p_size")))
    top = sized.orderBy(by("s", True), "p_partkey").limit(50)
    return top.select("p_partkey", F.expr("row_number() OVER (ORDER BY s DESC NULLS LAST, p_partkey)").cast("long").alias("place"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 60 OFFSET 120")
def page_slice(t: Tables) -> DataFrame:
    return page(t.customer, [by("c_acctbal", True), F.col("c_custkey")], 3).select("c_custkey", "c_name")


@query("""
SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 40
""")
def role_rank_sort(t: Tables) -> DataFrame:
    rank = rank_of("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return t.orders.orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_limit(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT CASE WHEN p_size >= 50 THEN 50 WHEN p_size >= 30 THEN 30 WHEN p_size >= 20 THEN 20 WHEN p_size >= 10 THEN 10 END AS tier, count(*) AS n FROM part GROUP BY ALL")
def record_tiers(t: Tables) -> DataFrame:
    return t.part.groupBy(record_tier(F.col("p_size")).alias("tier")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT s_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, sum(l_extendedprice) AS usd FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT s_suppkey, round(3 * parts + 2 * n + 5 * log10(usd + 1), 4) AS browse_score FROM s
""")
def browse_score(t: Tables) -> DataFrame:
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey").agg(
        F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.sum("l_extendedprice").alias("usd"))
    return s.select("s_suppkey", F.round(3 * F.col("parts") + 2 * F.col("n") + 5 * F.log10(F.col("usd") + 1), 4).alias("browse_score"))
