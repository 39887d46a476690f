"""Roll-ups, verdicts, merges, judging and rule queries over derived records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import records
from fathomline.operators.keys import latest, top_per_group
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query

_PERSON = """p AS (SELECT o_custkey AS person, o_orderpriority AS area, count(*) AS pubs, max(o_totalprice) AS z, min(o_orderkey) AS least FROM orders GROUP BY ALL),
t AS (SELECT o_custkey AS person, count(*) AS total FROM orders GROUP BY ALL)"""


def _person(t: Tables) -> DataFrame:
    p = t.orders.groupBy(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("area")).agg(F.count("*").alias("pubs"), F.max("o_totalprice").alias("z"))
    total = t.orders.groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("total"))
    return p.join(total, "person")


@query(f"WITH {_PERSON} SELECT person, max(total) AS works, round(sum(z), 2) AS composite, count(*) AS areas FROM p JOIN t USING (person) GROUP BY ALL")
def person_rollup(t: Tables) -> DataFrame:
    return _person(t).groupBy("person").agg(F.max("total").alias("works"), F.round(F.sum("z"), 2).alias("composite"), F.count("*").alias("areas"))


@query(f"WITH {_PERSON} SELECT person, CAST(sum(pubs) AS BIGINT) AS works, round(sum(z), 2) AS composite FROM p JOIN t USING (person) GROUP BY ALL")
def person_rollup_sum(t: Tables) -> DataFrame:
    return _person(t).groupBy("person").agg(F.sum("pubs").alias("works"), F.round(F.sum("z"), 2).alias("composite"))


@query("""
WITH c AS (SELECT s_suppkey, s_nationkey, s_acctbal > 0 AS funded,
  s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) AS big, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1) AS returns FROM supplier)
SELECT s_suppkey, 3 * CAST(funded AS INTEGER) + 2 * CAST(big AS INTEGER) + CAST(returns AS INTEGER) AS score FROM c ORDER BY score, s_suppkey LIMIT 30
""")
def coverage_score(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_quantity = 50").select("l_suppkey").distinct().withColumn("big", F.lit(2))
    returns = t.lineitem.where("l_returnflag = 'R' AND l_discount = 0.1").select("l_suppkey").distinct().withColumn("returns", F.lit(1))
    s = t.supplier.withColumnRenamed("s_suppkey", "l_suppkey").join(big, "l_suppkey", "left").join(returns, "l_suppkey", "left")
    score = F.when(F.col("s_acctbal") > 0, 3).otherwise(0) + F.coalesce("big", F.lit(0)) + F.coalesce("returns", F.lit(0))
    return s.select(F.col("l_suppkey").alias("s_suppkey"), score.alias("score")).orderBy("score", "s_suppkey").limit(30)


@query("""
WITH w AS (SELECT l_suppkey AS person, l_orderkey AS work, p_name LIKE '%ring%' AS med FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT person, count(DISTINCT work) AS n_total, count(DISTINCT work) FILTER (WHERE med) AS n_med,
       round(count(DISTINCT work) FILTER (WHERE med) / count(DISTINCT work), 6) AS pct FROM w GROUP BY ALL HAVING pct > 0.1
""")
def suspect_attributions(t: Tables) -> DataFrame:
    w = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("person"), "l_orderkey", F.contains("p_name", F.lit("ring")).alias("med"))
    per = w.groupBy("person", "l_orderkey").agg(F.max("med").alias("med")).groupBy("person").agg(F.count("*").alias("n_total"), F.count_if("med").alias("n_med"))
    return per.withColumn("pct", F.round(F.col("n_med") / F.col("n_total"), 6)).where("pct > 0.1")


@query("""
WITH c AS (SELECT c_custkey, count(DISTINCT o_orderpriority) AS coauthors, count(o_orderkey) AS works, c_nationkey < 5 AS ror, c_custkey % 4 = 0 AS orcid
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT c_custkey, 3 * coauthors + works / 2 + CASE WHEN ror THEN 10 ELSE 0 END + CASE WHEN orcid THEN 2 ELSE 0 END AS score FROM c)
SELECT c_custkey, round(score, 1) AS score, CASE WHEN score <= 10 THEN 'low' WHEN score <= 40 THEN 'medium' ELSE 'high' END AS priority FROM s
""")
def candidate_priority(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("coauthors"), F.count("*").alias("works"))
    c = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("coauthors", F.lit(0)).alias("coauthors"), F.coalesce("works", F.lit(0)).alias("works"),
        (F.col("c_nationkey") < 5).alias("has_ror"), (F.col("c_custkey") % 4 == 0).alias("has_orcid"))
    return records.candidate_scores(c).select("c_custkey", F.round(F.col("score").cast("double"), 1).alias("score"), "priority")


@query("""
WITH s AS (SELECT user_id AS url, CASE WHEN value > 15 THEN NULL ELSE CAST(value AS INTEGER) END AS code, ts, event_id FROM events),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY code IS NULL, ts DESC, event_id) = 1)
SELECT CASE WHEN code IS NULL THEN 'unreachable' WHEN code < 2 THEN 'ok' WHEN code < 5 THEN 'moved' ELSE 'broken' END AS status, count(*) AS n FROM l GROUP BY ALL
""")
def sweep_latest(t: Tables) -> DataFrame:
    s = t.events.select(F.col("user_id").alias("url"), F.when(F.col("value") <= 15, F.rint("value").cast("int")).alias("code"), "ts", "event_id")
    best = latest(s, "url", F.col("code").isNull(), F.desc("ts"), F.col("event_id"))
    status = F.when(F.col("code").isNull(), "unreachable").when(F.col("code") < 2, "ok").when(F.col("code") < 5, "moved").otherwise("broken")
    return best.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, 'name' AS check_id, CASE WHEN c_nationkey >= 20 THEN 'not_applicable' WHEN c_acctbal < 100 THEN 'fail' ELSE 'pass' END AS verdict, c_name AS evidence FROM customer
UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_mktsegment IS NULL THEN 'not_applicable' WHEN c_custkey % 9 = 0 THEN 'unresolved' WHEN c_mktsegment = 'BUILDING' THEN 'pass' ELSE 'fail' END, c_mktsegment FROM customer
""")
def verdict_generator(t: Tables) -> DataFrame:
    checks = [
        ("name", F.col("c_nationkey") < 20, F.col("c_acctbal") >= 100, F.col("c_name")),
        ("segment", F.col("c_mktsegment").isNotNull(), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment") == "BUILDING"), F.col("c_mktsegment")),
    ]
    return records.verdicts(t.customer, "c_custkey", checks)


@query("""
WITH c AS (SELECT o_custkey AS k, o_orderkey AS candidate, o_orderstatus <> 'F' AS g1, o_totalprice > 100000 AS g2, CAST(o_orderpriority[1] AS INTEGER) AS pri FROM orders),
good AS (SELECT k, min(pri) AS best, arg_min(candidate, (pri, candidate)) AS cand FROM c WHERE g1 AND g2 GROUP BY ALL),
tie AS (SELECT k, count(*) > 1 AS tie FROM c JOIN good USING (k) WHERE g1 AND g2 AND pri = best GROUP BY ALL),
bad AS (SELECT k, max(CASE WHEN NOT g1 THEN 0 WHEN NOT g2 THEN 1 END) AS why FROM c GROUP BY ALL)
SELECT k, CASE WHEN NOT tie THEN cand END AS candidate, CASE WHEN cand IS NULL THEN CASE why WHEN 0 THEN 'status' ELSE 'price' END WHEN tie THEN 'ambiguous' ELSE 'accepted' END AS decision
FROM (SELECT DISTINCT k FROM c) LEFT JOIN good USING (k) LEFT JOIN tie USING (k) LEFT JOIN bad USING (k)
""")
def judge_candidates(t: Tables) -> DataFrame:
    c = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("candidate"), "o_orderstatus", "o_totalprice", F.substring("o_orderpriority", 1, 1).cast("int").alias("pri"))
    return records.judged(c, "k", [("status", F.col("o_orderstatus") != "F"), ("price", F.col("o_totalprice") > 100000)], [F.col("pri")])


@query("""
WITH u AS (SELECT trim(url) AS url, 'pages' AS label FROM pages UNION ALL
  SELECT trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))), 'links' FROM pages)
SELECT url, string_agg(DISTINCT label, ', ' ORDER BY label) AS used_in, count(*) AS n FROM u WHERE url <> '' GROUP BY ALL
""")
def url_inventory_all(t: Tables) -> DataFrame:
    """Urls of all pages and of the links in them."""
    links = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    return records.url_inventory([(t.pages, "url", "pages"), (links, "url", "links")])


@query("""
SELECT o_orderkey, c AS "constraint" FROM (SELECT o_orderkey, unnest(list_filter([
  CASE WHEN o_totalprice < 50000 THEN 'price too low' END, CASE WHEN o_orderstatus = 'P' AND NOT o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pending needs priority' END], lambda x: x IS NOT NULL)) AS c FROM orders)
""")
def shape_violations(t: Tables) -> DataFrame:
    shapes = [
        ("price too low", F.lit(True), F.col("o_totalprice") >= 50000),
        ("pending needs priority", F.col("o_orderstatus") == "P", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
    ]
    return records.shape_violations(t.orders, "o_orderkey", shapes)


_CLAIMS = "SELECT DISTINCT l_orderkey AS orcid, l_suppkey AS author FROM lineitem WHERE l_linenumber"


@query(f"WITH a AS ({_CLAIMS} = 1), b AS ({_CLAIMS} = 2) SELECT a.orcid, a.author, b.author AS other_id FROM a JOIN b ON a.orcid = b.orcid AND a.author <> b.author")
def split_identities(t: Tables) -> DataFrame:
    side = lambda n: t.lineitem.where(f"l_linenumber = {n}").select(F.col("l_orderkey").alias("orcid"), F.col("l_suppkey").alias("author")).distinct()
    return records.split_identities(side(1), side(2), "orcid", "author").select("orcid", "author", "other_id")


@query("""
WITH r AS (SELECT o_custkey AS g, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'n' || o_orderkey END AS name, o_orderstatus AS status, CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 2 ELSE 0 END AS rank, o_orderkey AS seq FROM orders)
SELECT g, arg_max(name, (rank, -seq)) FILTER (WHERE name <> '') AS name, arg_max(status, (rank, -seq)) AS status FROM r GROUP BY ALL
""")
def merged_records(t: Tables) -> DataFrame:
    r = t.orders.selectExpr("o_custkey AS g", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'n' || o_orderkey END AS name", "o_orderstatus AS status",
                            "CASE o_orderstatus WHEN 'O' THEN 'high' WHEN 'F' THEN 'medium' ELSE 'unknown' END AS confidence", "o_orderkey AS seq")
    return records.merged_records(r, "g", ["name", "status"])


@query("""
WITH k AS (SELECT lower(c_mktsegment) || ' ' || c_nationkey AS name, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 END AS orcid, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS extra FROM customer),
f AS (SELECT *, 2 + CAST(orcid IS NOT NULL AS INTEGER) + CAST(extra IS NOT NULL AS INTEGER) AS filled FROM k)
SELECT arg_min(k, (-filled, k)) AS k, CASE WHEN min(orcid) = max(orcid) THEN min(orcid) END AS orcid, CASE WHEN min(orcid) <> max(orcid) THEN 'orcid' ELSE '' END AS conflicts FROM f GROUP BY name
""")
def merged_people(t: Tables) -> DataFrame:
    people = t.customer.selectExpr("upper(c_mktsegment) || ' ' || c_nationkey AS name", "c_custkey AS k", "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 END AS orcid", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS extra")
    return records.merged_people(people, "k", "name", ["orcid"])[0].select("k", "orcid", "conflicts")


@query("""
WITH o AS (SELECT DISTINCT p_brand AS overlay FROM part), g AS (SELECT DISTINCT p_brand AS overlay, p_type AS tag FROM part WHERE p_size < 4)
SELECT overlay, overlay IN ('Brand#3') OR overlay NOT IN (SELECT overlay FROM g WHERE tag IN ('ECONOMY')) AS hidden FROM o
""")
def overlay_visibility(t: Tables) -> DataFrame:
    overlays = t.part.select(F.col("p_brand").alias("overlay")).distinct()
    tags = t.part.where("p_size < 4").select(F.col("p_brand").alias("overlay"), F.col("p_type").alias("tag")).distinct()
    return records.hidden_overlays(overlays, tags, ["ECONOMY"], ["Brand#3"])


@query("""
WITH e AS (SELECT s_suppkey, s_nationkey, CAST(1960 + s_suppkey % 70 AS INTEGER) AS established FROM supplier)
SELECT s_suppkey, s_nationkey < 15 AND greatest(0, 2024 - established) >= 10 AS keep,
       CASE WHEN s_nationkey >= 15 THEN 'country out of scope' WHEN greatest(0, 2024 - established) < 10 THEN 'record too short' ELSE 'kept' END AS reason FROM e
""")
def scope_decision(t: Tables) -> DataFrame:
    years = F.greatest(F.lit(0), 2024 - (1960 + F.col("s_suppkey") % 70))
    reason = F.when(F.col("s_nationkey") >= 15, "country out of scope").when(years < 10, "record too short").otherwise("kept")
    return t.supplier.select("s_suppkey", (reason == "kept").alias("keep"), reason.alias("reason"))


@query(r"""
WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(list_filter(w[1:5], lambda x: x IN ('the', 'la', 'die', 'el'))) > 0 AS head_signal, len(list_filter(w, lambda x: x IN ('and', 'et', 'und', 'y'))) >= 2 AS twice FROM k
""")
def keyword_signals(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f]+"), lambda x: x != "")
    return t.documents.select("doc_id", words.alias("w")).select(
        "doc_id", F.exists(F.slice("w", 1, 5), lambda x: x.isin("the", "la", "die", "el")).alias("head_signal"),
        (F.size(F.filter("w", lambda x: x.isin("and", "et", "und", "y"))) >= 2).alias("twice"))


@query("""
WITH t AS (SELECT DISTINCT p_name AS topic FROM part), a AS (SELECT * FROM (VALUES ('ring'), ('bolt'), ('red'), ('blue bolt')) v(area)),
e AS (SELECT topic, area, 0 AS rule FROM t JOIN a ON topic = area), s AS (SELECT topic, min(area) AS area, 1 AS rule FROM t JOIN a ON contains(topic, area) GROUP BY topic HAVING count(*) = 1)
SELECT topic, arg_min(area, rule) AS area FROM (SELECT * FROM e UNION ALL SELECT * FROM s) GROUP BY topic
""")
def topic_area_map(t: Tables) -> DataFrame:
    """Exact label, else the only vocabulary label inside the topic; the vocabulary has a fixed size."""
    topics = t.part.select(F.col("p_name").alias("topic")).distinct()
    vocabulary = F.array(*(F.lit(v) for v in ("ring", "bolt", "red", "blue bolt")))
    inside = F.filter(vocabulary, lambda a: F.contains(F.col("topic"), a))
    area = F.when(F.array_contains(vocabulary, F.col("topic")), F.col("topic")).when(F.size(inside) == 1, F.get(inside, F.lit(0)))
    return topics.select("topic", area.alias("area")).where("area IS NOT NULL")


@query("""
SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, p_partkey) = 1
""")
def authoritative_source(t: Tables) -> DataFrame:
    rank = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    return top_per_group(t.part, "p_brand", [rank, F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey")
