"""Snapshots, staged publication, counted loads and budget-cut batches."""

import pytest
from pyspark.sql import functions as F

from fathomline.sources.catalog import Catalog
from fathomline.sources.publish import Snapshots, content_digest, load, publish, released
from fathomline.streaming.incremental import next_batch, run_batches


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_digest_follows_content_only(table):
    df = table([(1, "a", {"k": 1}), (2, None, None), (2, None, None)], "k int, v string, m map<string,int>")
    assert content_digest(df) == content_digest(df.repartition(3).orderBy(F.desc("k")))
    assert content_digest(df) != content_digest(df.where("k = 2").unionByName(df.where("k = 2")))
    assert content_digest(df.limit(0)) == (0, "0" * 32)


def test_snapshots_read_as_of(spark, table, tmp_path):
    held = Snapshots(spark, f"{tmp_path}/lake")
    assert held.latest() == 0 and held.entries() == {}
    one = held.commit({"a": table([(1, "x"), (2, "y")], "k int, v string"), "b": table([(9,)], "k int")})
    two = held.commit({"a": table([(2, "z"), (3, "y")], "k int, v string")})
    assert (one, two) == (1, 2) and held.latest() == 2
    assert rows(held.read("a", 1)) == [(1, "x"), (2, "y")] and rows(held.read("a")) == [(2, "z"), (3, "y")] and rows(held.read("b")) == [(9,)]
    assert rows(held.changes("a", "k", 1, 2).select("k", "change")) == [(1, "removed"), (2, "changed"), (3, "added")]
    assert held.entries(1)["b"] == held.entries(2)["b"]
    for name, number in (("c", None), ("a", 7)):
        with pytest.raises(KeyError):
            held.read(name, number)


def test_a_commit_that_dies_is_never_seen(spark, table, tmp_path):
    held = Snapshots(spark, f"{tmp_path}/lake")
    held.commit({"a": table([(1,)], "k int")})
    broken = table([(2,)], "k int").select(F.raise_error(F.lit("gone")).cast("int").alias("k"))
    with pytest.raises(Exception):  # noqa: B017
        held.commit({"a": table([(5,)], "k int"), "b": broken})
    assert held.latest() == 1 and rows(held.read("a")) == [(1,)]


def test_publish_stops_at_missing_tables_and_points_when_whole(spark, table, tmp_path):
    table([(1,), (2,)], "k int").write.parquet(f"{tmp_path}/db/a.parquet")
    table([(3,)], "k int").write.parquet(f"{tmp_path}/db/b.parquet")
    catalog, root = Catalog(spark, f"{tmp_path}/db"), f"{tmp_path}/out"
    for expected, present in ((["a", "c"], ["a"]), (["a"], ["a", "b"])):
        with pytest.raises(ValueError, match="missing: c|extra: b"):
            publish(catalog, expected, present, root)
    assert released(spark, root) == {}
    assert publish(catalog, ["a"], ["a"], root) == 1 and publish(catalog, ["a", "b"], ["a", "b"], root) == 2
    assert {k: v[1] for k, v in released(spark, root).items()} == {"a": 2, "b": 1} and list(released(spark, root, 1)) == ["a"]
    assert rows(spark.read.parquet(released(spark, root)["a"][0])) == [(1,), (2,)]


def test_load_counts_what_it_drops(spark, table, tmp_path):
    child = table([(1, 1, "x"), (2, 9, "x"), (3, None, None), (4, 9, "z"), (5, 2, "z")], "k int, area int, net string")
    parents = [("area", table([(1,), (2,), (2,), (None,)], "id int"), "id"), ("net", table([("x",)], "n string"), "n")]
    assert load(child, parents, f"{tmp_path}/c") == {"read": 5, "written": 2, "dropped": 3, "area": 2, "net": 2}
    assert rows(spark.read.parquet(f"{tmp_path}/c")) == [(1, 1, "x"), (3, None, None)]
    assert load(child.limit(0), parents, f"{tmp_path}/c")["read"] == 0


def test_cut_batches_come_first_and_nothing_is_taken_twice(spark, table, tmp_path):
    work = table([(k, k // 4) for k in range(12)], "k int, batch long")
    sink, ledger = f"{tmp_path}/sink", f"{tmp_path}/ledger"
    go = lambda budget, consume=lambda df: df.select("k"): run_batches(work, consume, "k", sink, ledger, budget)
    assert go(0) == [] and go(6) == [(0, "done", 4), (1, "cut", 2)] and next_batch(spark, work, ledger) == 1

    def dies(df):
        df.select("k").write.mode("append").parquet(sink)
        raise RuntimeError("killed after its results were written")

    with pytest.raises(RuntimeError):
        go(6, dies)
    assert go(1) == [(1, "done", 0), (2, "cut", 1)]  # what the killed call had written counts
    assert go(50) == [(2, "done", 3)] and go(50) == [] and next_batch(spark, work, ledger) is None
    assert rows(spark.read.parquet(sink)) == sorted(((k,) for k in range(12)), key=repr)
