"""Spatial queries; coordinates come from keys by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.spatial import haversine_km, nearest, polygon_join
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query

_PLACE = "({k} * 37 % 1200) / 10.0e0 - 60.05e0 AS lat, ({k} * 91 % 3400) / 10.0e0 - 170.05e0 AS lng"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


@query(f"""
WITH p AS (SELECT c_custkey, {_PLACE.format(k='c_custkey')} FROM customer), s AS (SELECT s_suppkey, {_PLACE.format(k='(s_suppkey + 3)')} FROM supplier)
SELECT c_custkey, s_suppkey AS target, round({_KM.format(a='p.lat', b='p.lng', c='s.lat', d='s.lng')}, 4) AS km FROM p CROSS JOIN s
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {_KM.format(a='p.lat', b='p.lng', c='s.lat', d='s.lng')}, s_suppkey) = 1
""")
def haversine_nearest(t: Tables) -> DataFrame:
    points = t.customer.selectExpr("c_custkey", *_PLACE.format(k="c_custkey").replace("e0", "D").split(", "))
    targets = t.supplier.selectExpr("s_suppkey AS target", *_PLACE.format(k="(s_suppkey + 3)").replace("e0", "D").split(", "))
    return nearest(points, targets, "c_custkey").select("c_custkey", "target", F.round("km", 4).alias("km"))


def _in_polygons(t: Tables, suppliers: DataFrame) -> DataFrame:
    points = t.customer.selectExpr("c_custkey", *_PLACE.format(k="c_custkey").replace("e0", "D").split(", "))
    corner = suppliers.selectExpr("s_suppkey", "CAST(s_nationkey * 12 - 160 AS DOUBLE) AS x", "CAST(s_suppkey % 9 * 12 - 55 AS DOUBLE) AS y")
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    outer, hole = F.array(at(0, 0), at(8, 0), at(0, 8)), F.array(at(1, 1), at(2, 1), at(2, 2), at(1, 2))
    polygons = corner.select("s_suppkey", F.array(outer, hole).alias("rings"))
    return polygon_join(points, polygons, "lng", "lat", cell=5.0).select("c_custkey", "s_suppkey")


@query(f"""
WITH p AS (SELECT c_custkey, {_PLACE.format(k='c_custkey')} FROM customer),
g AS (SELECT s_suppkey, s_nationkey * 12 - 160 AS x, s_suppkey % 9 * 12 - 55 AS y FROM supplier)
SELECT c_custkey, s_suppkey FROM p JOIN g ON lng > x AND lng < x + 8 AND lat > y AND lat < y + 8 - (lng - x)
  AND NOT (lng > x + 1 AND lng < x + 2 AND lat > y + 1 AND lat < y + 2)
""")
def point_in_polygon_all(t: Tables) -> DataFrame:
    """Customers in the polygons of all suppliers."""
    return _in_polygons(t, t.supplier)


@query(f"SELECT c_custkey, round({_KM.format(a='lat', b='lng', c='0.0', d='0.0')}, 4) AS km FROM (SELECT c_custkey, {_PLACE.format(k='c_custkey')} FROM customer)")
def haversine_origin(t: Tables) -> DataFrame:
    points = t.customer.selectExpr("c_custkey", *_PLACE.format(k="c_custkey").replace("e0", "D").split(", "))
    return points.select("c_custkey", F.round(haversine_km("lat", "lng", F.lit(0.0), F.lit(0.0)), 4).alias("km"))
