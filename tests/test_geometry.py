"""Splitting, flattening and dissolving beside plain loops."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from fathomline.operators import geometry, spatial

RINGS = "array<array<struct<x: double, y: double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def area(points):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def test_split_keeps_areas_and_crosses_nowhere(table):
    polygons = [
        [ring((170, 0), (-170, 0), (-170, 10), (170, 10))],
        [ring((175, -5), (-175, -5), (-178, 5), (178, 20), (175, -5))],
        [ring((160, 0), (-160, 0), (-160, 30), (160, 30)), ring((175, 5), (175, 9), (-175, 9), (-175, 5)), ring((165, 5), (166, 5), (166, 6))],
        [ring((179, 0), (-179, 0), (-179, 4), (179, 4), (-179.5, 2))],
        [ring((1, 1), (2, 1), (2, 2))],
        [ring((170, 0), (180, 0), (180, 5), (170, 5))],
    ]
    df = table([(k, p) for k, p in enumerate(polygons)], f"k int, rings {RINGS}").withColumn("parts", geometry.split_at_antimeridian("rings"))
    parts = df.select("k", F.posexplode("parts").alias("i", "part")).withColumn("area", geometry.rings_area("part"))
    crossing = parts.select(F.explode("part").alias("r")).where(spatial.crosses_antimeridian("r")).count()
    got = {}
    for r in parts.collect():
        got.setdefault(r.k, []).append(r.area)
    assert crossing == 0 and [len(got[k]) for k in range(6)] == [2, 2, 2, 2, 1, 1]
    for k, p in enumerate(polygons):
        wide = [[{"x": v["x"] + 360 if v["x"] < 0 and k < 4 else v["x"], "y": v["y"]} for v in r] for r in p]
        want = abs(area(wide[0])) - sum(abs(area(r)) for r in wide[1:])
        assert abs(sum(got[k]) - want) < 1e-9


def test_collections_are_flattened(table):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    nested = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": square}]}, {"type": "MultiPolygon", "coordinates": [square, square]}]}
    df = table([(1, json.dumps(nested)), (2, json.dumps({"type": "Polygon", "coordinates": square})), (3, json.dumps({"type": "LineString", "coordinates": [[0, 0]]})), (4, None), (5, "no json")], "k int, g string")
    found = geometry.flattened(df, "k", "g").collect()
    assert sorted((r.k, r.part) for r in found) == [(1, 0), (1, 1), (1, 2), (2, 0)] and all(len(r.rings[0]) == 4 for r in found)


def cells_of(filled):
    return [[ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)) if (x + y) % 2 else ring((x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y))] for x, y in filled]


def parts_of(cells, steps):
    left, n = set(cells), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            x, y = todo.pop()
            for dx, dy in steps:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
    return n


def test_dissolve_is_a_cell_fill(table):
    rnd, rows, want = random.Random(5), [], {}
    four = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    eight = [*four, (1, 1), (1, -1), (-1, 1), (-1, -1)]
    shapes = {0: {(0, 0)}, 1: {(0, 0), (1, 1)}, 2: {(x, y) for x in range(5) for y in range(5)} - {(1, 1), (2, 2), (3, 1)}, 3: {(x, 0) for x in range(40)}}
    shapes |= {k: {(x, y) for x in range(9) for y in range(9) if rnd.random() < 0.6} for k in range(4, 9)}
    for k, filled in shapes.items():
        rows += [(k, p) for p in cells_of(filled)] + [(k, p) for p in cells_of(list(filled)[:2])]  # some twice
        empty = {(x, y) for x in range(-1, 42) for y in range(-1, 11)} - filled
        want[k] = (len(filled), parts_of(filled, four), parts_of(empty, eight) - 1)
    found = geometry.dissolved(table(rows, f"k int, rings {RINGS}"), "k").collect()
    total, outer, holes = Counter(), Counter(), Counter()
    for r in found:
        assert abs(area([v.asDict() for v in r.ring]) - r.area) < 1e-9
        total[r.k] += r.area
        (outer if r.area > 0 else holes)[r.k] += 1
    assert {k: (round(total[k]), outer[k], holes[k]) for k in shapes} == want
    assert geometry.dissolved(table([], f"k int, rings {RINGS}"), "k").count() == 0
