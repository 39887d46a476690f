"""Dissolving and splitting of polygons made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import geometry
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query


@query("""
WITH c AS (SELECT DISTINCT c_nationkey AS k, c_custkey % 12 AS x, CAST(floor(c_acctbal / 1000) AS BIGINT) AS y FROM customer),
n AS (SELECT k, count(*) AS cells FROM c GROUP BY k),
p AS (SELECT a.k, count(*) AS pairs FROM c a JOIN c b ON a.k = b.k AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY a.k),
q AS (SELECT a.k, count(*) AS blocks FROM c a JOIN c b ON a.k = b.k AND b.x = a.x + 1 AND b.y = a.y JOIN c d ON a.k = d.k AND d.x = a.x AND d.y = a.y + 1 JOIN c e ON a.k = e.k AND e.x = a.x + 1 AND e.y = a.y + 1 GROUP BY a.k)
SELECT n.k AS nation, CAST(cells AS DOUBLE) AS area, 4 * cells - 2 * coalesce(pairs, 0) AS edges, cells - coalesce(pairs, 0) + coalesce(blocks, 0) AS outer_less_holes
FROM n LEFT JOIN p USING (k) LEFT JOIN q USING (k)
""")
def dissolved_cells(t: Tables) -> DataFrame:
    """The cells of each nation's customers as one area: its size, the length of its edge, outer rings less holes."""
    at = t.customer.selectExpr("c_nationkey AS nation", "CAST(c_custkey % 12 AS DOUBLE) AS x", "CAST(floor(c_acctbal / 1000) AS DOUBLE) AS y")
    square = F.expr("array(array(struct(x AS x, y AS y), struct(x + 1 AS x, y AS y), struct(x + 1 AS x, y + 1 AS y), struct(x AS x, y + 1 AS y)))")
    found = geometry.dissolved(at.select("nation", square.alias("rings")), "nation")
    return found.groupBy("nation").agg(
        F.sum("area").alias("area"), F.sum(F.size("ring")).alias("edges"), F.sum(F.when(F.col("area") > 0, 1).otherwise(-1)).cast("long").alias("outer_less_holes"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 9 AS a, c_nationkey % 7 AS b, 1 + c_custkey % 4 AS h FROM customer)
SELECT c_custkey, side, CAST(w * h AS DOUBLE) - CASE WHEN w > 2 THEN 0.25 ELSE 0 END AS area FROM (
  SELECT c_custkey, 'east' AS side, a AS w, h FROM c WHERE b > 0 UNION ALL SELECT c_custkey, 'west', b, h FROM c WHERE b > 0
  UNION ALL SELECT c_custkey, 'east', a, h FROM c WHERE b = 0) WHERE w > 0
""")
def split_rectangles(t: Tables) -> DataFrame:
    """Rectangles over the date line with a hole on each wide side, from GeoJSON in nested collections, split into sides."""
    c = t.customer.selectExpr("c_custkey", "c_custkey % 9 AS a", "c_nationkey % 7 AS b", "1 + c_custkey % 4 AS h")
    point = lambda x, y: f"'[', {x}, ',', {y}, ']'"
    ring = lambda x0, y0, x1, y1: f"'[', {point(x0, y0)}, ',', {point(x1, y0)}, ',', {point(x1, y1)}, ',', {point(x0, y1)}, ',', {point(x0, y0)}, ']'"
    right = "if(b = 0, 180, -180 + b)"
    hole_a, hole_b = f"if(a > 2, concat(',', {ring(178.5, 0.25, 179, 0.75)}), '')", f"if(b > 2, concat(',', {ring(-179, 0.25, -178.5, 0.75)}), '')"
    polygon = f"concat('{{\"type\":\"Polygon\",\"coordinates\":[', {ring('180 - a', 0, right, 'h')}, {hole_a}, {hole_b}, ']}}')"
    nested = f"""concat('{{"type":"GeometryCollection","geometries":[{{"type":"Point","coordinates":[0,0]}},{{"type":"GeometryCollection","geometries":[', {polygon}, ']}}]}}')"""
    parts = geometry.flattened(c.withColumn("g", F.expr(f"if(c_custkey % 2 = 0, {nested}, {polygon})")), "c_custkey", "g")
    each = parts.select("c_custkey", F.explode(geometry.split_at_antimeridian("rings")).alias("part")).where(geometry.rings_area("part") > 0)
    side = F.when(F.expr("part[0][0].x > 0"), "east").otherwise("west")
    return each.select("c_custkey", side.alias("side"), geometry.rings_area("part").alias("area"))
