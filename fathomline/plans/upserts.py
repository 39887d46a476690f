"""Upsert, patch and quality queries: customers are the stored rows, deltas are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import short_key
from fathomline.operators import quality, upsert
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query

_STORED = "stored AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal, c_mktsegment AS src FROM customer WHERE c_custkey % 3 <> 2)"
_NEW = "delta AS (SELECT c_custkey AS id, 'new ' || c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS bal, c_mktsegment AS src, c_nationkey AS seq FROM customer WHERE c_custkey % 2 = 0)"


def _stored(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 3 <> 2").selectExpr("c_custkey AS id", "c_name AS name", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal", "c_mktsegment AS src")


def _new(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 2 = 0").selectExpr(
        "c_custkey AS id", "'new ' || c_name AS name", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS bal", "c_mktsegment AS src", "c_nationkey AS seq")


@query(f"WITH {_STORED}, {_NEW} SELECT * FROM stored UNION ALL SELECT id, name, bal, src FROM delta WHERE id NOT IN (SELECT id FROM stored)")
def upsert_ignore(t: Tables) -> DataFrame:
    return upsert.insert_ignore(_stored(t), _new(t), "id", "seq")


@query(f"WITH {_STORED}, {_NEW} SELECT id, name, bal, src FROM delta UNION ALL SELECT * FROM stored WHERE id NOT IN (SELECT id FROM delta)")
def upsert_replace(t: Tables) -> DataFrame:
    return upsert.insert_replace(_stored(t), _new(t), "id", "seq")


_MERGED = "SELECT id, coalesce({0}.name, {1}.name) AS name, coalesce({0}.bal, {1}.bal) AS bal, coalesce({0}.src, {1}.src) AS src FROM stored FULL JOIN delta USING (id)"


@query(f"WITH {_STORED}, {_NEW} " + _MERGED.format("delta", "stored"))
def upsert_coalesce(t: Tables) -> DataFrame:
    return upsert.merge(_stored(t), _new(t).drop("seq"), "id")


@query(f"WITH {_STORED}, {_NEW} " + _MERGED.format("stored", "delta"))
def upsert_fill_only(t: Tables) -> DataFrame:
    return upsert.merge(_stored(t), _new(t).drop("seq"), "id", prefer="stored")


@query(f"WITH {_STORED}, {_NEW} SELECT * FROM stored WHERE src IS DISTINCT FROM 'MACHINERY' UNION ALL SELECT id, name, bal, src FROM delta WHERE src = 'MACHINERY'")
def delete_by_owner(t: Tables) -> DataFrame:
    return upsert.replace_owned(_stored(t), _new(t).where("src = 'MACHINERY'"), "src", "MACHINERY")


_LOG = """log AS (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'O' THEN 'name' WHEN 'F' THEN 'bal' ELSE 'nosuch' END AS field, CAST(o_orderkey AS VARCHAR) AS new_value, o_orderkey AS seq FROM orders
  UNION ALL SELECT c_custkey, 'DELETE-ROW', NULL, -1 FROM customer WHERE c_custkey % 50 = 1)"""


def _log(t: Tables) -> DataFrame:
    log = t.orders.selectExpr("o_custkey AS id", "CASE o_orderstatus WHEN 'O' THEN 'name' WHEN 'F' THEN 'bal' ELSE 'nosuch' END AS field", "CAST(o_orderkey AS STRING) AS new_value", "o_orderkey AS seq")
    return log.unionByName(t.customer.where("c_custkey % 50 = 1").selectExpr("c_custkey AS id", "'DELETE-ROW' AS field", "CAST(NULL AS STRING) AS new_value", "-1L AS seq"))


@query(f"""
WITH {_STORED}, {_LOG}, newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) = 1)
SELECT id, coalesce((SELECT new_value FROM newest n WHERE n.id = s.id AND field = 'name'), name) AS name,
       coalesce((SELECT CAST(new_value AS DOUBLE) FROM newest n WHERE n.id = s.id AND field = 'bal'), bal) AS bal, src
FROM stored s WHERE id NOT IN (SELECT id FROM newest WHERE field = 'DELETE-ROW')
""")
def patch_log(t: Tables) -> DataFrame:
    return upsert.apply_patches(_stored(t), _log(t), "id", ["name", "bal"])


@query(f"""
WITH {_STORED}, {_LOG}
SELECT id, field, new_value, seq, CASE WHEN id NOT IN (SELECT id FROM stored) THEN 'unknown key' ELSE 'unknown field' END AS reason
FROM log WHERE id NOT IN (SELECT id FROM stored) OR field = 'nosuch'
""")
def patch_log_rejected(t: Tables) -> DataFrame:
    return upsert.rejected_patches(_stored(t), _log(t), "id", ["name", "bal"])


@query(f"""
WITH {_STORED} SELECT id, CASE WHEN id % 6 = 0 THEN 'fixed' ELSE name END AS name, bal, src FROM stored
""")
def compare_and_set(t: Tables) -> DataFrame:
    changes = t.customer.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 6 = 0 THEN c_name ELSE 'other' END AS expected", "'fixed' AS value")
    return upsert.compare_and_set(_stored(t), changes, "id", "name")


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'customer' AS tab, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)
""")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.customer.where("c_acctbal < 0").select("c_custkey")
    tables = {"customer": t.customer, "orders": t.orders.withColumnRenamed("o_custkey", "c_custkey")}
    left = upsert.cascade_delete(tables, gone, "c_custkey")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@query("""
WITH links AS (SELECT DISTINCT l_suppkey AS id, l_returnflag AS sphere FROM lineitem WHERE l_quantity > 45),
prim AS (SELECT id, sphere, sphere = min(sphere) OVER (PARTITION BY id) AS is_primary FROM links),
owners AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 8)
SELECT id, sphere, is_primary AND id NOT IN (SELECT id FROM owners) AS is_primary FROM prim WHERE NOT (id IN (SELECT id FROM owners) AND sphere = 'R')
UNION ALL SELECT id, 'R', true FROM owners
UNION ALL SELECT id, 'X', false FROM owners
""")
def primary_flip(t: Tables) -> DataFrame:
    links = t.lineitem.where("l_quantity > 45").selectExpr("l_suppkey AS id", "l_returnflag AS sphere").distinct()
    least = links.groupBy("id").agg(F.min("sphere").alias("m"))
    prim = links.join(least, "id").select("id", "sphere", (F.col("sphere") == F.col("m")).alias("is_primary"))
    owners = t.supplier.where("s_nationkey < 8").select(F.col("s_suppkey").alias("id"))
    return upsert.flip_primary(prim, owners, "id", "sphere", "R", ["X"])


@query("""
SELECT 'order without customer' AS rule, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS violations
UNION ALL SELECT 'line without part', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
""")
def qa_orphans_all(t: Tables) -> DataFrame:
    """Orders without their customer and lines without their part."""
    rules = [
        quality.Rule("order without customer", lambda: quality.orphans(t.orders, "o_custkey", t.customer, "c_custkey")),
        quality.Rule("line without part", lambda: quality.orphans(t.lineitem, "l_partkey", t.part, "p_partkey")),
    ]
    return quality.report(t.spark, rules).drop("passed")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 1")
def qa_multi_primary(t: Tables) -> DataFrame:
    return quality.several(t.lineitem.withColumn("p", F.col("l_returnflag") == "R"), "l_orderkey", "p")


@query("""
SELECT s_suppkey FROM supplier WHERE substr(sha1(lower(s_name) || '|' || lower(CASE WHEN s_suppkey % 10 = 3 THEN 'moved' ELSE s_name END)), 1, 16)
IS DISTINCT FROM substr(sha1(lower(s_name) || '|' || lower(s_name)), 1, 16)
""")
def qa_key_drift(t: Tables) -> DataFrame:
    keyed = t.supplier.withColumn("key", short_key("s_name", F.expr("CASE WHEN s_suppkey % 10 = 3 THEN 'moved' ELSE s_name END")))
    return quality.drifted(keyed, "key", short_key("s_name", "s_name")).select("s_suppkey")


@query("""
SELECT 'priority enum' AS rule, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS violations FROM orders
UNION ALL SELECT 'null total', count(*) - count(o_totalprice) FROM orders
UNION ALL SELECT 'name form', count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) FROM customer
UNION ALL SELECT 'edge order', count(*) FILTER (WHERE NOT l_suppkey < l_partkey) FROM lineitem
""")
def qa_report(t: Tables) -> DataFrame:
    rules = [
        quality.Rule("priority enum", lambda: quality.not_in(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])),
        quality.Rule("null total", lambda: quality.nulls(t.orders, "o_totalprice")),
        quality.Rule("name form", lambda: quality.malformed(t.customer, "c_name", "^Customer#[0-9]{9}$")),
        quality.Rule("edge order", lambda: quality.disordered(t.lineitem, "l_suppkey", "l_partkey")),
    ]
    return quality.report(t.spark, rules).drop("passed")
