from pyspark.sql import functions as F

from fathomline.functions import text as x
from fathomline.operators import fuzzy, graph, keys, metrics, nested, predicates, quality, sorting, spatial, upsert


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_h_index(table):
    df = table([("a", c) for c in (10, 8, 5, 4, 3)] + [("b", 0), ("c", None), ("d", 7)], "g string, c int")
    want = [("a", 4), ("b", 0), ("c", 0), ("d", 1)]
    assert rows(df.groupBy("g").agg(metrics.h_index("c").alias("h"))) == want
    assert rows(metrics.h_index_of_groups(df, "g", "c")) == want


def test_h_index_of_groups_with_ties(table):
    df = table([("a", 3)] * 5 + [("a", 1)] * 9, "g string, c int")
    assert rows(metrics.h_index_of_groups(df, "g", "c")) == [("a", 3)]


def test_z_composite_without_spread(table):
    df = table([("a", 1, 5.0), ("a", 1, 7.0), ("b", 3, 1.0)], "g string, n int, v double")
    found = {(r.g, r.v): round(r.composite_z, 4) for r in metrics.z_composite(df, "g", ["n", "v"]).collect()}
    assert found == {("a", 5.0): -0.7071, ("a", 7.0): 0.7071, ("b", 1.0): 0.0}


def test_global_rank_with_ties_and_nulls(spark, table):
    values = [(float(i % 17),) for i in range(300)] + [(None,), (None,)]
    df = table(values, "v double")
    found = {(r.v, r.r) for r in metrics.global_ranks(df, {"v": "r"}).collect()}
    ordered = sorted(v for (v,) in values if v is not None)
    assert found == {(None, 0)} | {(v, 2 + ordered.index(v)) for v in ordered}


def test_tier_cut_keeps_pinned_above_core_size(table):
    df = table([(i, float(i), i < 3) for i in range(6)], "k int, s double, pinned boolean")
    assert {r.k for r in metrics.tier_cut(df, "s", "pinned", 2, "k").where("tier = 'core'").collect()} == {0, 1, 2}
    assert {r.k for r in metrics.tier_cut(df, "s", "pinned", 4, "k").where("tier = 'core'").collect()} == {0, 1, 2, 5}


def test_arg_max_skips_null_values(table):
    df = table([(1, "x", 1), (1, None, 9), (2, None, 3)], "g int, v string, k int")
    assert rows(df.groupBy("g").agg(metrics.arg_max("v", "k").alias("v"))) == [(1, "x"), (2, None)]


def test_ordered_structs_nulls_last(table):
    df = table([(1, "a", 10), (1, None, 20), (1, "b", None)], "g int, v string, k int")
    made = df.groupBy("g").agg(nested.ordered_structs([("k", True)], ["v"]).alias("l")).first().l
    assert [r.v for r in made] == [None, "a", "b"]
    up = df.groupBy("g").agg(nested.ordered_structs([("k", False)], ["v"]).alias("l")).first().l
    assert [r.v for r in up] == ["a", None, "b"]


def test_lists(table):
    df = table([(["a", "b"], ["b", "c"]), (None, ["c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(nested.merged_lists("a", "b")).collect()] == [["a", "b", "c"], ["c"]]
    assert df.limit(1).select(nested.chips("a", 1)).first()[0] == "a +1 more"


def test_facets(table):
    df = table([(1, "A", 5, "Ocean"), (2, "B", None, "Sea"), (3, "A", 9, None)], "id int, kind string, y int, name string")
    links = table([(1, "x"), (3, "y")], "id int, area string")
    ids = lambda f: sorted(r.id for r in f.apply(df).collect())
    assert ids(predicates.Facets()) == [1, 2, 3]
    assert ids(predicates.Facets(values={"kind": ["A"], "name": []})) == [1, 3]
    assert ids(predicates.Facets(ranges={"y": (None, 8)})) == [1]
    assert ids(predicates.Facets(linked={"id": (links, "area", ["x", "y"])}, text="oce", text_columns=("name",))) == [1]


def test_rules_and_flags(table):
    df = table([("red x", "site, scholar"), ("q", None)], "t string, c string")
    made = df.select(predicates.first_rule(F.col("t"), [("^red", "R"), ("x", None)], F.lit("-")), predicates.token_flag("c", "scholar"))
    assert rows(made) == [("-", False), ("R", True)]


def test_upserts(table):
    old = table([(1, "a", None), (2, "b", 5)], "k int, v string, n int")
    new = table([(2, None, 6, 1), (3, "c", 7, 1), (3, "d", 8, 2)], "k int, v string, n int, seq int")
    assert rows(upsert.insert_ignore(old, new, "k", "seq")) == [(1, "a", None), (2, "b", 5), (3, "c", 7)]
    assert rows(upsert.insert_replace(old, new, "k", "seq")) == [(1, "a", None), (2, None, 6), (3, "d", 8)]
    one = new.where("seq = 1").drop("seq")
    assert rows(upsert.merge(old, one, "k")) == [(1, "a", None), (2, "b", 6), (3, "c", 7)]
    assert rows(upsert.merge(old, one, "k", prefer="stored")) == [(1, "a", None), (2, "b", 5), (3, "c", 7)]


def test_patches(table):
    old = table([(1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5)], "k int, v string, n double")
    log = table([(1, "v", "x", 1), (1, "v", "y", 2), (2, "n", "9", 3), (3, "DELETE-ROW", None, 4), (9, "v", "z", 5), (1, "w", "z", 6)], "k int, field string, new_value string, seq int")
    assert rows(upsert.apply_patches(old, log, "k", ["v", "n"])) == [(1, "y", 1.5), (2, "b", 9.0)]
    assert sorted(r.reason for r in upsert.rejected_patches(old, log, "k", ["v", "n"]).collect()) == ["unknown field", "unknown key"]


def test_replace_owned_keeps_null_owner(table):
    old = table([(1, "a"), (2, None), (3, "b")], "k int, o string")
    assert rows(upsert.replace_owned(old, table([(4, "a")], "k int, o string"), "o", "a")) == [(2, None), (3, "b"), (4, "a")]


def test_conforming(table):
    df = table([(1, "2")], "b int, a string")
    assert upsert.conforming(df, {"a": "int", "b": "bigint"}).dtypes == [("a", "int"), ("b", "bigint")]
    assert upsert.with_missing(df, {"a": "int", "z": "string"}).first().z is None
    try:
        upsert.conforming(df, {"z": "int"})
    except ValueError as e:
        assert "z" in str(e)
    else:
        raise AssertionError


def test_cascade_prefers_first_unique_rule(table):
    df = table([(1,), (2,), (3,)], "id int")
    a = table([(1, "x"), (2, "y"), (2, "z")], "id int, target string")
    b = table([(1, "w"), (2, "v")], "id int, target string")
    assert rows(keys.resolve_cascade(df, "id", [a, b])) == [(1, "x", 0), (2, "v", 1), (3, None, None)]


def test_cascade_looks_values_up_once(table):
    df = table([(1, "many"), (2, "one"), (2, "two"), (3, "one"), (4, None), (5, "none"), (5, "one")], "id int, name string")
    many = table([("many", k) for k in range(200)] + [("one", 7), ("one", 7), ("two", 8), (None, 9)], "value string, target int")
    found = keys.resolve_cascade(df, "id", [(F.col("name"), many), (F.upper("name"), table([("MANY", 3)], "value string, target int"))])
    assert rows(found) == [(1, 3, 1), (2, None, None), (3, 7, 0), (4, None, None), (5, 7, 0)]


def test_items_are_dealt_to_tasks_by_their_number(table, monkeypatch):
    works = table([(i // 3, i * 7 % 10, 2000 + i % 5) for i in range(600)] + [(None, 1, 2000), (None, 2, 2000)], "w int, p int, y int")
    found = rows(metrics.co_occurrence(works, "w", "p", "y"))
    monkeypatch.setattr(metrics, "TASK_ROWS", 50)
    assert metrics.dealt(works, "w").rdd.getNumPartitions() == 13
    assert rows(metrics.co_occurrence(works, "w", "p", "y")) == found and sum(r[2] for r in found) == 600


def test_pairs_are_dealt_to_tasks_by_their_number(table, monkeypatch):
    works = table([(i // 3, i * 7 % 200, 2000 + i % 5) for i in range(600)] + [(None, 1, 2000), (7, None, 2000)], "w int, p int, y int")
    few = metrics.co_occurrence(works, "w", "p", "y")
    assert few.rdd.getNumPartitions() <= 4
    monkeypatch.setattr(metrics, "TASK_ROWS", 25)
    found = metrics.co_occurrence(works, "w", "p", "y")
    assert 30 <= found.rdd.getNumPartitions() <= 40  # 600 pairs; the number of items is an estimate
    assert rows(found) == rows(few) and sum(r.n for r in found.collect()) == 600
    none = metrics.co_occurrence(works.where("w IS NULL"), "w", "p", "y")
    assert rows(none) == []


def test_contested(table):
    df = table([("k", 1), ("k", 2), ("l", 3), ("l", 3)], "c string, o int")
    assert rows(keys.contested(df, "c", "o").distinct()) == [("l", 3)]


def test_components(table):
    edges = table([(i, i + 1) for i in range(1, 40)] + [(100, 101), (None, 3)], "a long, b long")
    found = dict(map(tuple, graph.components(edges).collect()))
    assert all(found[i] == 1 for i in range(1, 41)) and found[101] == 100


def test_edges_are_dealt_to_tasks_by_their_number(table, monkeypatch):
    edges, seen, kept = table([(i, i + 1) for i in range(1, 40)] * 2 + [(100, 101), (7, 7), (50, 50)], "a long, b long"), [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: seen.append(df.rdd.getNumPartitions()) or kept(df))
    monkeypatch.setattr(metrics, "TASK_ROWS", 10)
    found = dict(map(tuple, graph.components(edges).collect()))
    assert found == {i: 1 for i in range(1, 41)} | {50: 50, 100: 100, 101: 100}
    assert seen[1:3] == [17, 17]  # 81 edges, both ways


def test_collapse_follows_chains():
    ends = graph.collapse_map([("leaf", 1), ("mid", 1), ("top", 10), ("lone", 1)], {"leaf": "mid", "mid": "top", "top": None, "lone": None}, 3)
    assert ends == {"leaf": "top", "mid": "top", "top": "top", "lone": "lone"}


def test_roots_with_cycle(table):
    df = table([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "k int, p int")
    found = {r.k: r.root for r in graph.roots(df, "k", "p").collect()}
    assert found[3] == 1 and found[8] in (8, 9)


def test_roots_of_a_deep_chain(table):
    df = table([(i, i - 1 if i else None) for i in range(400)], "k int, p int")
    found = {r.k: (r.root, r.depth) for r in graph.roots(df, "k", "p").collect()}
    assert found == {i: (0, i) for i in range(400)}


def test_angles_and_amounts(table):
    df = table([("36.417°N", "FY 2019 = 1,234.50"), ("36°N 116°W", "FY2020 = $7 FY 20x = 3"), ("none", None), ("12°30'S, 5°15'36\"E", "FY 2021 = $2,000.")], "g string, f string")
    found = df.select(x.angles("g"), x.yearly_amounts("f")).collect()
    assert [r[0] for r in found] == [[36.417], [36.0, -116.0], [], [-12.5, 5.26]]
    assert [r[1] and [tuple(v) for v in r[1]] for r in found] == [[(2019, 1234.5)], [(2020, 7.0)], None, [(2021, 2000.0)]]


def test_nearest_crosses_the_date_line(table):
    points = table([(1, 0.0, 179.9), (2, 10.0, 0.0), (3, None, 1.0)], "id int, lat double, lng double")
    targets = table([(7, 0.0, -179.9), (8, 0.0, 170.0), (9, -80.0, 100.0)], "target int, lat double, lng double")
    assert [(r.id, r.target) for r in spatial.nearest(points, targets, "id").orderBy("id").collect()][0] == (1, 7)
    assert spatial.nearest(points, targets, "id").count() == 2


def test_farthest_points_are_brute_force(table):
    at = [(i, (i * 37 % 101) / 7, (i * 53 % 97) / 5) for i in range(60)] + [(90, None, 1.0)]
    chosen = [at[0]]
    while len(chosen) < 6:
        gap = lambda p: min((p[1] - c[1]) ** 2 + (p[2] - c[2]) ** 2 for c in chosen)
        chosen.append(min(at[:60], key=lambda p: (-gap(p), p[0])))
    got = spatial.farthest_points(table(at, "k int, x double, y double"), "k", "x", "y", 6)
    assert [r.k for r in got.orderBy("turn").collect()] == [c[0] for c in chosen]


def test_polygon_with_hole(table):
    ring = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    polygons = table([("p", [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))])], "id string, rings array<array<struct<x: double, y: double>>>")
    points = table([(1, 1.5, 1.5), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, 9.5, 9.5)], "k int, x double, y double")
    assert sorted(r.k for r in spatial.polygon_join(points, polygons, "x", "y", cell=3.0).collect()) == [1, 4]


def test_haversine_and_antimeridian(table):
    df = table([(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    assert round(df.select(spatial.haversine_km("a", "b", "c", "d")).first()[0], 1) == 20015.1
    rings = table([([{"x": 179.0, "y": 0.0}, {"x": -179.0, "y": 1.0}],), ([{"x": 1.0, "y": 0.0}, {"x": 2.0, "y": 1.0}],)], "r array<struct<x: double, y: double>>")
    assert [r[0] for r in rings.select(spatial.crosses_antimeridian("r")).collect()] == [True, False]


def test_token_set_ratio():
    assert fuzzy.token_set("Ocean Lab", "lab ocean") == 100.0
    assert fuzzy.token_set("ocean lab", "ocean lab west") == 100.0
    assert fuzzy.token_set("", "x") == 0.0
    assert fuzzy.token_set("ocean lab", "ocean bay") == fuzzy.indel_ratio("ocean bay", "ocean lab")


def test_fuzzy_join_is_all_pairs(table):
    names = ["ocean lab", "ocean laboratory", "bay station", "station bay east", "reef"]
    a, b = table([(n,) for n in names], "l string"), table([(n,) for n in names], "r string")
    want = {(p, q) for p in names for q in names if fuzzy.token_set(p, q) >= 85 and set(p.split()) & set(q.split())}
    assert {(r.l, r.r) for r in fuzzy.fuzzy_join(a, b, "l", "r", 85.0).collect()} == want


def test_quality_report(spark, table):
    df = table([(1, "a"), (2, None)], "k int, v string")
    made = quality.report(spark, [quality.Rule("v", lambda: quality.nulls(df, "v")), quality.Rule("k", lambda: quality.nulls(df, "k"))])
    assert rows(made) == [("k", 0, True), ("v", 1, False)]
    assert quality.report(spark, []).count() == 0
    assert quality.wide_types(df.selectExpr("CAST(k AS DECIMAL(9,2)) AS d", "v")) == ["d"]


def test_sorting(table):
    df = table([(1, None), (2, 5), (3, 7)], "k int, v int")
    assert [r.k for r in df.orderBy(sorting.by("v")).collect()] == [2, 3, 1]
    assert [r.k for r in df.orderBy(sorting.by("v", True)).collect()] == [3, 2, 1]
    assert [r.k for r in sorting.page(df, [F.col("k")], 99, 2).collect()] == [3]


def test_text_functions(table):
    df = table([("see https://orcid.org/0000-0002-1825-009x", "https://www.Sea.example.org/A/", "10/01/2020", "FY 2019 = $1,234.50; FY2020 = $7", "12 30 00 S", "Jöhn")],
               "a string, u string, d string, f string, g string, n string")
    r = df.select(x.orcid("a"), x.bare_url("u"), x.apex_domain("u"), x.fiscal_year(x.us_date("d")), x.yearly_amounts("f"), x.dms("g"), x.unaccented("n"), x.slug("n"), x.last_segment("u")).first()
    assert r[:4] == ("0000-0002-1825-009X", "sea.example.org/a", "example.org", 2021)
    assert [tuple(v) for v in r[4]] == [(2019, 1234.5), (2020, 7.0)]
    assert r[5:] == (-12.5, "John", "j-hn", "A")


def test_given_names(table):
    df = table([("J. R.", "John Robert"), ("Jane", "John"), ("A", ""), ("Ann", "Ann Marie")], "a string, b string")
    assert [r[0] for r in df.select(x.given_names_agree(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
