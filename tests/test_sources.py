import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.sources import readers, sinks
from fathomline.sources.catalog import Catalog
from fathomline.streaming import incremental


def test_csv_with_comments_and_quotes(spark, tmp_path):
    (tmp_path / "v.csv").write_text('# note\nslug,label\na,"x, ""y"""\nb,\n')
    got = readers.csv(spark, str(tmp_path / "v.csv"), "slug string, label string", comment="#").collect()
    assert [tuple(r) for r in got] == [("a", 'x, "y"'), ("b", None)]


def test_json_arrays_skip_invalid(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "old.json").write_text('[{"k": 9}]')
    got = readers.json_arrays(spark, f"{tmp_path}/*.json", StructType.fromDDL("k int"), skip="old")
    assert sorted(r.k for r in got.collect()) == [1, 2]


def test_any_shape(table):
    df = table([('[{"u": "a"}]',), ('{"results": [{"u": "b"}]}',), ('{"x": 1}',)], "j string")
    got = df.select(readers.any_shape(F.col("j"), "struct<u: string>", ("items", "results")).alias("r"))
    assert [[v.u for v in r.r] for r in got.collect()] == [["a"], ["b"], []]


def test_nested_tables(table):
    df = table([(1, [{"n": "x"}], [{"o": 5}, {"o": 6}])], "id int, people array<struct<n: string>>, roles array<struct<o: int>>")
    made = readers.nested_tables(df, {"people": ["id"], "roles": ["id"]})
    assert [tuple(r) for r in made["roles"].collect()] == [(1, 5), (1, 6)]


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [
        {"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"properties": {"name": ""}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"name": "C"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"features": features}))
    got = readers.geojson(spark, str(tmp_path / "g.json"), "name: string").collect()
    assert [(r.name, len(r.polygons)) for r in got] == [("A", 1), ("B", 2)]


def test_front_matter(table):
    df = table([("---\ntitle: A: b\nslug: x\n---\nbody",), ("no matter",)], "t string")
    assert [r[0] for r in df.select(readers.front_matter(F.col("t"))).collect()] == [{"title": "A: b", "slug": "x"}, {}]


def test_catalog_and_sinks(spark, table, tmp_path):
    table([(1, 2.0), (2, None)], "r_regionkey int, v double").write.parquet(f"{tmp_path}/in/region.parquet")
    c = Catalog(spark, f"{tmp_path}/in")
    assert c.get("nation") is None
    assert c.sql("SELECT count(*) AS n FROM region WHERE r_regionkey > :least", least=1).first().n == 1
    assert c.projected("region", ["missing"], ["v"]).columns == ["v"]
    assert sinks.export(c, ["region", "nation"], f"{tmp_path}/out") == {"region": "written", "nation": "missing"}
    assert all(len(r.sha256) == 64 for r in sinks.manifest(spark, f"{tmp_path}/out").collect())
    assert sinks.preflight(c, ["region", "nation"], ["region", "x"]) == {"missing": ["nation"], "extra": ["x"]}


def test_features_and_edges(table):
    nodes = table([(1, 3.0, 4.0), (2, None, 1.0)], "k int, lng double, lat double")
    line = json.loads(sinks.feature_lines(nodes, "lng", "lat", ["k"]).first().value)
    assert line["geometry"]["coordinates"] == [3.0, 4.0] and line["properties"] == {"k": 1}
    edges = table([(1, 2), (1, 9)], "a int, b int")
    assert [(r.a, r.b) for r in sinks.closed_edges(edges, nodes, "k").collect()] == [(1, 2)]


def test_bundle_and_turtle(table):
    archives = table([("a", "Arc"), ("b", "Empty")], "id string, name string")
    products = table([("a", "x", 3), ("a", "y", None), ("a", "z", 9)], "id string, title string, cited_by_count int")
    text = {r.id: r.text for r in sinks.bundle(archives, products, "id", top=2).collect()}
    assert "- z (9 citations)\n- x (3 citations)" in text["a"] and "# Empty" in text["b"]
    lines = [r.value for r in sinks.turtle(table([("http://a", "http://p", 'say "hi"'), ("http://a", "http://p", "http://b")], "s string, p string, o string")).collect()]
    assert lines == ['<http://a> <http://p> "say \\"hi\\"" .', "<http://a> <http://p> <http://b> ."]


def test_drain_is_resumable(spark, table, tmp_path):
    schema = StructType.fromDDL("k int, v string")
    run = lambda: incremental.drain(spark, f"{tmp_path}/src", schema, f"{tmp_path}/sink", f"{tmp_path}/cp", ["k"], 1)
    table([(1, "a"), (1, "a")], "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    run()
    run()
    assert incremental.settled(spark, f"{tmp_path}/sink", ["k"]).count() == 1
    table([(1, "b"), (2, "c")], "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    run()
    assert sorted((r.k, r.v) for r in incremental.settled(spark, f"{tmp_path}/sink", ["k"]).collect()) == [(1, "b"), (2, "c")]


def test_windowed_counts(table):
    df = table([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, k string")
    got = incremental.windowed_counts(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "k").collect()
    assert sorted(r.n for r in got) == [1, 2]
