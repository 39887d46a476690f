"""Polygons as arrays of rings: splitting at the date line, flattening collections, dissolving on a shared mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.graph import checkpoints

_RINGS = "array<array<struct<x: double, y: double>>>"


def ring_area(ring: str) -> str:
    """SQL for the signed area of a ring: positive counter-clockwise. A repeated first vertex adds nothing."""
    return (
        f"aggregate(sequence(1, greatest(size({ring}), 1)), 0.0D, (a, i) -> a + coalesce({ring}[i - 1].x * {ring}[i % size({ring})].y "
        f"- {ring}[i % size({ring})].x * {ring}[i - 1].y, 0.0D)) / 2")


def rings_area(rings: str) -> Column:
    """The area of a polygon: its first ring without the others."""
    return F.expr(f"aggregate({rings}, struct(0 AS n, 0.0D AS a), (s, r) -> struct(s.n + 1 AS n, s.a + if(s.n = 0, 1, -1) * abs({ring_area('r')}) AS a), s -> s.a)")


def flattened(df: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, part, rings): the polygons of GeoJSON geometries as text, those of nested collections too; other kinds are dropped.

    Each round opens the collections of the last, so rounds are as many as collections are nested. Texts that aren't geometries give no rows.
    """
    left, found = df.select(key, F.col(geometry).alias("g"), F.array().cast("array<int>").alias("at")), None
    while True:
        kinds = left.withColumn("kind", F.get_json_object("g", "$.type"))
        one = kinds.where("kind = 'Polygon'").select(key, "at", F.from_json(F.get_json_object("g", "$.coordinates"), "array<array<array<double>>>").alias("c"))
        many = kinds.where("kind = 'MultiPolygon'").select(key, "at", F.posexplode(F.from_json(F.get_json_object("g", "$.coordinates"), "array<array<array<array<double>>>>")).alias("i", "c")).select(
            key, F.concat("at", F.array("i")).alias("at"), "c")
        both = one.unionByName(many)
        found = both if found is None else found.unionByName(both)
        left = kinds.where("kind = 'GeometryCollection'").select(
            key, "at", F.posexplode(F.from_json(F.get_json_object("g", "$.geometries"), "array<string>")).alias("i", "g")).select(key, "g", F.concat("at", F.array("i")).alias("at"))
        if not left.limit(1).count():
            break
    rings = F.expr(f"CAST(transform(c, r -> transform(r, p -> struct(p[0] AS x, p[1] AS y))) AS {_RINGS})")
    part = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return found.where("c IS NOT NULL AND size(c) > 0").select(key, part.alias("part"), rings.alias("rings"))


def _clipped(ring: str, west: bool) -> str:
    """SQL for the part of a ring on one side of 180 degrees, with the points where it crosses."""
    edges = f"zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)), (p, q) -> struct(p, q))"
    at = "struct(180.0D AS x, e.p.y + (180.0D - e.p.x) * (e.q.y - e.p.y) / (e.q.x - e.p.x) AS y)"
    return (
        f"flatten(transform({edges}, e -> concat(if(e.p.x {'<=' if west else '>='} 180.0D, array(e.p), array()), "
        f"if((e.p.x - 180.0D) * (e.q.x - 180.0D) < 0, array({at}), array()))))")


def split_at_antimeridian(rings: str) -> Column:
    """The polygons (array of rings each) into which a polygon falls at 180 degrees; one that has no edge over 180 degrees long stays.

    Negative longitudes are taken on beyond 180, both sides are clipped there, and the eastern one is taken back. The areas add up to the whole;
    a part may run along the date line between its pieces. Rings without area go, and a polygon whose outer ring goes is left out.
    """
    shifted = f"transform({rings}, r -> transform(r, p -> struct(if(p.x < 0, p.x + 360.0D, p.x) AS x, p.y AS y)))"
    side = lambda west: f"filter(transform({shifted}, r -> {_clipped('r', west)}), r -> size(r) > 2 AND abs({ring_area('r')}) > 0)"
    back = f"transform({side(False)}, r -> transform(r, p -> struct(p.x - 360.0D AS x, p.y AS y)))"
    crossing = F.expr(f"exists({rings}, r -> exists(sequence(1, greatest(size(r) - 1, 1)), i -> i < size(r) AND abs(r[i].x - r[i - 1].x) > 180))")
    return F.when(~crossing, F.array(F.expr(rings))).otherwise(F.filter(F.array(F.expr(side(True)), F.expr(back)), lambda x: F.size(x) > 0))


def _directed(polygons: DataFrame, group: str, rings: str) -> DataFrame:
    """(group, ax, ay, bx, by): the edges of all rings once each, with the inside on the left."""
    turned = F.expr(f"transform({rings}, (r, i) -> if(({ring_area('r')} > 0) = (i = 0), r, reverse(r)))")
    ring = polygons.select(group, F.explode(turned).alias("r")).where("size(r) > 2")
    edge = F.expr("zip_with(r, concat(slice(r, 2, size(r)), slice(r, 1, 1)), (p, q) -> struct(p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by))")
    return ring.select(group, F.explode(edge).alias("e")).select(group, "e.*").where("ax <> bx OR ay <> by").distinct()


def boundary(polygons: DataFrame, group: str, rings: str = "rings") -> DataFrame:
    """(group, ax, ay, bx, by): the edges around the union of each group's polygons, which share the vertices of a mesh and don't overlap.

    An edge that two neighbours run through in opposite directions lies inside and goes, in one aggregation by edge; repeated
    polygons count once.
    """
    edges = _directed(polygons, group, rings)
    ahead = "ax < bx OR (ax = bx AND ay < by)"
    way = edges.select(group, *(F.expr(f"if({ahead}, {a}, {b})").alias(c) for c, a, b in (("ux", "ax", "bx"), ("uy", "ay", "by"), ("vx", "bx", "ax"), ("vy", "by", "ay"))), F.expr(f"if({ahead}, 1, -1)").alias("way"))
    left = way.groupBy(group, "ux", "uy", "vx", "vy").agg(F.sum("way").alias("way")).where("way <> 0")
    return left.select(group, *(F.expr(f"if(way > 0, {a}, {b})").alias(c) for c, a, b in (("ax", "ux", "vx"), ("ay", "uy", "vy"), ("bx", "vx", "ux"), ("by", "vy", "uy"))))


def dissolved(polygons: DataFrame, group: str, rings: str = "rings") -> DataFrame:
    """(group, ring, area): the rings around the union of each group's polygons; outer ones have a positive area, holes a negative one.

    The edges of boundary are stitched where one ends and another begins; where several begin, the sharpest turn to the left
    follows, so parts that touch in a corner stay apart. Each edge then finds the least edge of its ring and its distance to it by doubling its
    steps, in rounds that grow with the logarithm of the longest ring.
    """
    checkpoints(polygons.sparkSession)
    edges = boundary(polygons, group, rings).withColumn("e", F.xxhash64(F.col(group), "ax", "ay", "bx", "by")).checkpoint()
    after = edges.select(group, F.col("e").alias("to"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    # the turn at the end of an edge, from back along its right side (0) round to back along its left (2 pi)
    turn = F.expr("pmod(atan2(cy - by, cx - bx) - atan2(ay - by, ax - bx), 2 * pi())")
    best = edges.join(after, [group, "bx", "by"]).withColumn("turn", turn).where("cx <> ax OR cy <> ay")
    step = best.groupBy("e").agg(F.max_by("to", "turn").alias("to"))
    at = step.select("e", "to", F.col("e").alias("least")).checkpoint()
    while True:
        ahead = at.select(F.col("e").alias("to"), F.col("to").alias("far"), F.col("least").alias("low"))
        moved = at.join(ahead, "to").select("e", F.col("far").alias("to"), F.least("least", "low").alias("least"), (F.col("low") < F.col("least")).alias("m")).checkpoint()
        going = moved.where("m").limit(1).count()
        at = moved.drop("m")
        if not going:
            break
    ring = at.select("e", "least")
    # steps to the least edge, where each chain ends
    hops = step.join(ring, "e").select("e", F.when(F.col("e") == F.col("least"), F.col("e")).otherwise(F.col("to")).alias("to"), (F.col("e") != F.col("least")).cast("long").alias("n")).checkpoint()
    while True:
        ahead = hops.select(F.col("e").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        moved = hops.join(ahead, "to").select("e", F.col("far").alias("to"), (F.col("n") + F.col("more")).alias("n"), (F.col("more") > 0).alias("m")).checkpoint()
        going = moved.where("m").limit(1).count()
        hops = moved.drop("m")
        if not going:
            break
    placed = edges.join(hops.select("e", F.col("to").alias("least"), "n"), "e")
    found = placed.groupBy(group, "least").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "ax", "ay"))).alias("v"))
    # the least edge has no steps left and comes first
    listed = found.withColumn("ring", F.expr("transform(concat(slice(v, size(v), 1), slice(v, 1, size(v) - 1)), p -> struct(p.ax AS x, p.ay AS y))"))
    return listed.select(group, "ring", F.expr(ring_area("ring")).alias("area"))
