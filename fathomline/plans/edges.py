"""Co-occurrence edges, degrees, endpoint joins and enriched star views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import components, roots, supergraph
from fathomline.operators.keys import either_end, with_endpoints
from fathomline.operators.metrics import co_occurrence, dealt, degree
from fathomline.operators.nested import chips, joined_set, ordered_structs, sorted_set
from fathomline.operators.predicates import band
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query

_PAIRS = """
WITH m AS (SELECT l_orderkey, l_suppkey, max(CAST(year(l_shipdate) AS INTEGER)) AS y FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY ALL),
pairs AS (SELECT x.l_suppkey AS a, z.l_suppkey AS b, count(*) AS n, min(x.y) AS first_year, max(x.y) AS last_year
          FROM m x JOIN m z ON x.l_orderkey = z.l_orderkey AND x.l_suppkey < z.l_suppkey GROUP BY ALL)
"""


def _pairs(t: Tables, least: int = 1) -> DataFrame:
    works = t.lineitem.select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    return co_occurrence(works, "l_orderkey", "l_suppkey", "y", least)


@query(_PAIRS + "SELECT *, least(n / 20.0, 1.0)::DOUBLE AS strength FROM pairs")
def coauthor_pairs(t: Tables) -> DataFrame:
    return _pairs(t)


@query(_PAIRS + "SELECT *, least(n / 20.0, 1.0)::DOUBLE AS strength FROM pairs WHERE n >= 5")
def coauthor_pairs_min(t: Tables) -> DataFrame:
    return _pairs(t, 5)


@query("""
WITH e AS (SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, l_orderkey AS work, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem)
SELECT a, b, count(DISTINCT work) AS works, min(y) AS first_year, max(y) AS last_year, min(work) AS exemplar FROM e WHERE a <> b GROUP BY ALL
""")
def evidenced_edges(t: Tables) -> DataFrame:
    other = F.col("l_partkey") % 100
    return t.lineitem.groupBy(F.least("l_suppkey", other).alias("a"), F.greatest("l_suppkey", other).alias("b")).agg(
        F.countDistinct("l_orderkey").alias("works"), F.min(F.year("l_shipdate")).alias("first_year"),
        F.max(F.year("l_shipdate")).alias("last_year"), F.min("l_orderkey").alias("exemplar"),
    ).where("a <> b")


@query(_PAIRS + "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY ALL")
def edge_degree(t: Tables) -> DataFrame:
    return degree(_pairs(t))


@query(_PAIRS + """
, d AS (SELECT s_suppkey, count(a) AS deg FROM supplier LEFT JOIN pairs ON s_suppkey = a OR s_suppkey = b GROUP BY ALL)
SELECT CASE WHEN deg = 0 THEN 'none' WHEN deg < 20 THEN 'few' WHEN deg < 60 THEN 'some' ELSE 'many' END AS band, count(*) AS n FROM d GROUP BY ALL
""")
def degree_bands(t: Tables) -> DataFrame:
    d = t.supplier.join(degree(_pairs(t)), F.col("s_suppkey") == F.col("node"), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.groupBy(band(F.col("degree"), ((1, "none"), (20, "few"), (60, "some")), "many", "none").alias("band")).agg(F.count("*").alias("n"))


@query(_PAIRS + """
SELECT least(x.s_nationkey, z.s_nationkey) AS site_a, greatest(x.s_nationkey, z.s_nationkey) AS site_b, CAST(sum(n) AS BIGINT) AS weight
FROM pairs JOIN supplier x ON a = x.s_suppkey JOIN supplier z ON b = z.s_suppkey WHERE x.s_nationkey <> z.s_nationkey GROUP BY ALL
""")
def site_edges(t: Tables) -> DataFrame:
    g = supergraph(_pairs(t).withColumnRenamed("n", "weight"), t.supplier, "s_suppkey", "s_nationkey")
    return g.where("ga <> gb").select(F.col("ga").alias("site_a"), F.col("gb").alias("site_b"), "weight")


@query(_PAIRS + """
SELECT x.s_nationkey AS site, CAST(sum(n) AS BIGINT) AS weight
FROM pairs JOIN supplier x ON a = x.s_suppkey JOIN supplier z ON b = z.s_suppkey WHERE x.s_nationkey = z.s_nationkey GROUP BY ALL
""")
def site_internal(t: Tables) -> DataFrame:
    g = supergraph(_pairs(t).withColumnRenamed("n", "weight"), t.supplier, "s_suppkey", "s_nationkey")
    return g.where("ga = gb").select(F.col("ga").alias("site"), "weight")


@query(_PAIRS + """
SELECT least(p.r_name, q.r_name) || ' - ' || greatest(p.r_name, q.r_name) AS pair, count(*) AS edges, CAST(sum(n) AS BIGINT) AS works
FROM pairs JOIN supplier x ON a = x.s_suppkey JOIN nation u ON x.s_nationkey = u.n_nationkey JOIN region p ON u.n_regionkey = p.r_regionkey
JOIN supplier z ON b = z.s_suppkey JOIN nation v ON z.s_nationkey = v.n_nationkey JOIN region q ON v.n_regionkey = q.r_regionkey GROUP BY ALL
""")
def edge_census(t: Tables) -> DataFrame:
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    e = with_endpoints(_pairs(t).select("a", "b", "n"), place, "s_suppkey", "r_name")
    pair = F.concat_ws(" - ", F.least("a_r_name", "b_r_name"), F.greatest("a_r_name", "b_r_name"))
    return e.groupBy(pair.alias("pair")).agg(F.count("*").alias("edges"), F.sum("n").alias("works"))


@query(_PAIRS + "SELECT a, b, n, x.s_name AS a_s_name, z.s_name AS b_s_name FROM pairs JOIN supplier x ON a = x.s_suppkey JOIN supplier z ON b = z.s_suppkey")
def edges_enriched(t: Tables) -> DataFrame:
    return with_endpoints(_pairs(t).select("a", "b", "n"), t.supplier, "s_suppkey", "s_name")


@query(_PAIRS + "SELECT a AS node, b AS other, n FROM pairs UNION ALL SELECT b, a, n FROM pairs")
def edges_densified(t: Tables) -> DataFrame:
    return either_end(_pairs(t).select("a", "b", "n"))


@query(_PAIRS + """
, s AS (SELECT l_suppkey, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48 GROUP BY ALL)
SELECT a, b, nullif(array_to_string(list_sort(list_intersect(x.brands, z.brands)), ','), '') AS shared
FROM pairs JOIN s x ON a = x.l_suppkey JOIN s z ON b = z.l_suppkey WHERE n >= 5
""")
def edge_context(t: Tables) -> DataFrame:
    s = t.lineitem.where("l_quantity > 48").join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("brands"))
    e = with_endpoints(_pairs(t, 5).select("a", "b"), s, "l_suppkey", "brands")
    return e.select("a", "b", F.nullif(F.array_join(F.array_sort(F.array_intersect("a_brands", "b_brands")), ","), F.lit("")).alias("shared"))


@query("""
SELECT s_suppkey, n_name, r_name,
  (SELECT array_to_string(list_sort(list(DISTINCT p_brand)), '|') FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey) AS brands,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS awards
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def star_enriched(t: Tables) -> DataFrame:
    # each branch is aggregated before it joins, so branches don't multiply one another
    brands = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(joined_set("p_brand").alias("brands"))
    awards = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.countDistinct("l_orderkey").alias("awards"))
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = place.join(brands, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(awards, F.col("s_suppkey") == F.col("k"), "left")
    return out.select("s_suppkey", "n_name", "r_name", "brands", F.coalesce("awards", F.lit(0)).alias("awards"))


@query("""
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT s_suppkey) AS facilities,
       array_to_string(list_sort(list(DISTINCT n_name)), '|') AS nation_names
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL
""")
def region_enriched(t: Tables) -> DataFrame:
    per = t.nation.join(t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("f")), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    g = per.groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.sum(F.coalesce("f", F.lit(0))).alias("facilities"), joined_set("n_name").alias("nation_names"))
    return t.region.join(g, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        "r_name", F.coalesce("nations", F.lit(0)).alias("nations"), F.coalesce("facilities", F.lit(0)).alias("facilities"), F.coalesce("nation_names", F.lit("")).alias("nation_names"))


@query("""
SELECT o_custkey AS person, array_to_string(list(o_orderkey || ':' || o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey), ',') AS cards, count(*) AS n
FROM orders GROUP BY ALL
""")
def nested_cards(t: Tables) -> DataFrame:
    cards = ordered_structs([("o_totalprice", True), ("o_orderkey", False)], ["o_orderkey", "o_orderstatus"])
    g = t.orders.groupBy(F.col("o_custkey").alias("person")).agg(cards.alias("c"), F.count("*").alias("n"))
    return g.select("person", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"])), ",").alias("cards"), "n")


@query("""
WITH b AS (SELECT l_suppkey, list_sort(list(DISTINCT p_type)) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_suppkey, CASE WHEN len(x) > 3 THEN array_to_string(x[1:3], ', ') || ' +' || (len(x) - 3) || ' more' ELSE array_to_string(x, ', ') END AS chips FROM b
""")
def capped_chips(t: Tables) -> DataFrame:
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(sorted_set("p_type").alias("x"))
    return b.select("l_suppkey", chips("x", 3).alias("chips"))


@query("""
WITH RECURSIVE h(k, p) AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey - p_partkey % 7 END FROM part),
up(k, root, depth) AS (SELECT k, k, 0 FROM h WHERE p IS NULL UNION ALL SELECT h.k, up.root, up.depth + 1 FROM h JOIN up ON h.p = up.k)
SELECT k AS node, root, depth FROM up
""")
def root_rollup(t: Tables) -> DataFrame:
    h = t.part.selectExpr("p_partkey AS node", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey - p_partkey % 7 END AS parent")
    return roots(h, "node", "parent").select("node", "root", "depth")


@query("""
WITH RECURSIVE up(k, root, depth) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey % 400 = 0 OR p_partkey - 1 NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT p_partkey, up.root, up.depth + 1 FROM part JOIN up ON p_partkey = up.k + 1 WHERE p_partkey % 400 <> 0)
SELECT k AS node, root, depth FROM up
""")
def deep_rollup(t: Tables) -> DataFrame:
    """Roots and depths of chains of 400 nodes."""
    held = t.part.selectExpr("p_partkey AS held")
    h = t.part.join(held, F.col("p_partkey") - 1 == F.col("held"), "left").selectExpr("p_partkey AS node", "CASE WHEN p_partkey % 400 = 0 THEN NULL ELSE held END AS parent")
    return roots(h, "node", "parent")


def _to_least(lines: DataFrame) -> DataFrame:
    """(a, b): each part of an order with the order's least part, which connects what all pairs would."""
    given = lines.select("l_orderkey", "l_partkey").where("l_partkey IS NOT NULL AND l_orderkey IS NOT NULL")
    e = dealt(given, "l_orderkey").distinct()
    least = e.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"))
    return e.join(least, "l_orderkey").where("a <> l_partkey").select("a", F.col("l_partkey").alias("b"))


@query()
def dedup_components_all(t: Tables) -> DataFrame:
    """Parts that orders connect, over all lines; a recursive closure in SQL is too slow for that."""
    return components(_to_least(t.lineitem))
