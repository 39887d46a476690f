"""Snapshots and loads over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import checkpoints
from fathomline.plans.define import Plans, Tables
from fathomline.sources.publish import Snapshots, orphans

PLANS = Plans()
query = PLANS.query


def _folder(t: Tables, label: str) -> str:
    checkpoints(t.spark)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"


@query("""
WITH a AS (SELECT c_custkey, c_acctbal AS bal FROM customer WHERE c_custkey % 10 > 0),
b AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer WHERE c_nationkey > 2)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  round(a.bal, 6) AS before, round(b.bal, 6) AS after FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.bal IS DISTINCT FROM b.bal
""")
def snapshot_changes(t: Tables) -> DataFrame:
    """Two snapshots of customers, read as of each: rows added, removed and changed."""
    held = Snapshots(t.spark, _folder(t, "snapshots"))
    one = held.commit({"customer": t.customer.where("c_custkey % 10 > 0").selectExpr("c_custkey", "c_acctbal AS bal"), "region": t.region})
    two = held.commit({"customer": t.customer.where("c_nationkey > 2").selectExpr("c_custkey", "if(c_mktsegment = 'BUILDING', c_acctbal + 1, c_acctbal) AS bal")})
    found = held.changes("customer", "c_custkey", one, two)
    return found.select("c_custkey", "change", F.round("before.bal", 6).alias("before"), F.round("after.bal", 6).alias("after"))


@query("""
SELECT 'o_custkey' AS "column", count(*) AS rows, count(DISTINCT o_custkey) AS "values" FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) HAVING count(*) > 0
UNION ALL SELECT 'o_orderkey', count(*), count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0
""")
def load_orphans(t: Tables) -> DataFrame:
    """Orders that a load against solvent customers and existing lines would send away, by reference."""
    return orphans(t.orders, [("o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey"), ("o_orderkey", t.lineitem, "l_orderkey")])
