"""Queries over whole tables beside brute force."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import metrics
from fathomline.operators.spatial import nearest_of_all, polygon_join
from fathomline.plans import edges, linkage, measures, space, upserts
from fathomline.plans.define import Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Fixture:
    """Given frames in the place of a data folder's tables."""

    def __init__(self, **frames):
        self.__dict__.update(frames)


def closure(rows):
    """The least part reachable over shared orders, for parts that share one."""
    held = {}
    for order, part in rows:
        held.setdefault(order, set()).add(part)
    groups = []
    for g in (set(x) for x in held.values() if len(x) > 1):
        for x in [x for x in groups if x & g]:
            groups.remove(x)
            g |= x
        groups.append(g)
    return {p: min(g) for g in groups for p in g}


def test_components_of_all_lines(table):
    rows = [(1, 5), (1, 6), (1, 6), (2, 6), (2, 9), (3, 7), (4, 8), (4, 2), (4, 3), (5, 3), (5, 11), (6, None)]
    lines = table([(o, p, 1.0, 0.0) for o, p in rows], "l_orderkey long, l_partkey long, l_quantity double, l_discount double")
    got = {r.node: r.component for r in edges.dedup_components_all(Fixture(lineitem=lines)).collect()}
    assert got == closure([x for x in rows if x[1] is not None])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_components_of_the_given_lines(spark):
    t = Tables(spark, SF)
    rows = [tuple(r) for r in t.lineitem.select("l_orderkey", "l_partkey").collect()]
    assert {r.node: r.component for r in edges.dedup_components_all(t).collect()} == closure(rows)


def test_all_suppliers_and_customers_count(spark, table):
    at = lambda k: ((k * 91 % 3400) / 10 - 170.05 + 160, (k * 37 % 1200) / 10 - 60.05 + 55)  # noqa: E731  beside the triangle's corner
    key = next(k for k in range(1, 30000) if at(k)[0] > 2.2 and at(k)[1] > 0.2 and sum(at(k)) < 7.8)
    t = Fixture(spark=spark, customer=table([(key,), (2000,)], "c_custkey long"), supplier=table([(90, 0)], "s_suppkey long, s_nationkey long"),
                orders=table([(1, 2000), (2, 3000)], "o_orderkey long, o_custkey long"), lineitem=table([(1, 1)], "l_orderkey long, l_partkey long"), part=table([(1,)], "p_partkey long"))
    assert (key, 90) in {tuple(r) for r in space.point_in_polygon_all(t).collect()}
    assert {r.rule: r.violations for r in upserts.qa_orphans_all(t).collect()} == {"order without customer": 1, "line without part": 0}


def test_codes_round_to_even(table):
    events = table([(1, 1, 4.5), (2, 2, 5.5), (3, 3, 1.5), (4, 4, 16.0)], "event_id long, user_id long, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert {r.status: r.n for r in linkage.sweep_latest(Fixture(events=events)).collect()} == {"moved": 2, "broken": 1, "unreachable": 1}


def test_urls_of_links(table):
    t = Fixture(pages=table([(1, "http://a.org/", '<a href="http://b.org/">b</a>'), (2, "http://b.org/", None)], "page_id long, url string, html string"))
    assert {r.url: (r.used_in, r.n) for r in linkage.url_inventory_all(t).collect()} == {"http://a.org/": ("pages", 1), "http://b.org/": ("links, pages", 2)}


def test_nearest_of_all_targets(table):
    rnd = random.Random(2)
    place = lambda: (rnd.uniform(-89, 89), rnd.uniform(-180, 180))
    p, t = [(i, *place()) for i in range(80)] + [(80, 10.0, 179.9)], [(i, *place()) for i in range(40)] + [(40, 10.0, -179.9)]
    cut = lambda a, b: sum((x - y) ** 2 for x, y in zip(ball(*a), ball(*b), strict=True))
    ball = lambda lat, lng: (math.cos(math.radians(lat)) * math.cos(math.radians(lng)), math.cos(math.radians(lat)) * math.sin(math.radians(lng)), math.sin(math.radians(lat)))
    got = nearest_of_all(table(p, "k int, lat double, lng double"), table(t, "target int, lat double, lng double"), "k").collect()
    assert {r.k: r.target for r in got} == {k: min(t, key=lambda y: cut(x, y[1:]))[0] for k, *x in p}


def test_a_place_is_looked_up_once(table):
    p = [(k, 10.0, 20.0) for k in range(50)] + [(50, 11.0, 20.0), (50, 11.0, 20.0)]
    t = [(k, 10.5, 20.0) for k in range(60, 20, -1)] + [(9, 40.0, 40.0)]
    found = nearest_of_all(table(p, "k int, lat double, lng double"), table(t, "target int, lat double, lng double"), "k")
    assert sorted((r.k, r.target) for r in found.collect()) == [(k, 21) for k in range(51)]


def test_scored_works_are_dealt_by_their_number(table, monkeypatch):
    rows = [(k // 3, k % 5, k % 4, 10.0, 0.05, "A") for k in range(300)]
    t = Fixture(lineitem=table(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"), part=table([(k, f"Brand#{k}") for k in range(5)], "p_partkey long, p_brand string"))
    before = sorted(map(tuple, measures.area_weighted_scores(t).collect()))
    monkeypatch.setattr(metrics, "TASK_ROWS", 20)
    assert measures._scored(t).rdd.getNumPartitions() == 16
    assert sorted(map(tuple, measures.area_weighted_scores(t).collect())) == before


def test_copies_of_places_and_shapes_are_all_given(table):
    points = table([(k, 1.0, 1.0) for k in range(20)] + [(20, 9.0, 9.0), (21, None, 1.0), (22, 1.0, 1.5)], "k int, x double, y double")
    ring = [[(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)]]
    polygons = table([(k, ring) for k in range(5)] + [(5, [[(8.0, 8.0), (11.0, 8.0), (8.0, 11.0)]])], "p int, rings array<array<struct<x: double, y: double>>>")
    got = sorted((r.k, r.p) for r in polygon_join(points, polygons, "x", "y").collect())
    assert got == sorted([(k, p) for k in [*range(20), 22] for p in range(5)] + [(20, 5)])


def test_authors_and_people_meet_as_kinds(table):
    from types import SimpleNamespace

    from fathomline.plans import further

    people = [(k, None if k % 17 == 0 else k * k % 5) for k in range(200)]
    authors = [(k, k * k % 5, float(k % 4 - 1)) for k in range(0, 140, 3)]
    found = further.author_resolver(SimpleNamespace(
        customer=table(people, "c_custkey long, c_nationkey int"), supplier=table(authors, "s_suppkey long, s_nationkey int, s_acctbal double")))
    want = {}
    for k, nation in people:
        met = [(a, n) for a, n, bal in authors if bal >= 0 and a % 40 == k % 40 and (a % 5 == k % 7 or a % 5 == 0)]
        home = [a for a, n in met if n == nation]
        one = home[0] if len(home) == 1 else met[0][0] if not home and len(met) == 1 else None
        want[k] = (one, "institution" if len(home) == 1 else "ambiguous" if home or len(met) > 1 else "single" if met else "none")
    assert {r.person: (r.author, r.rule) for r in found.collect()} == want and len({rule for _, rule in want.values()}) > 2
    assert " OR " not in found._jdf.queryExecution().optimizedPlan().toString()
