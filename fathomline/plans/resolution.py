"""Identifier resolution, text normalisation, classification and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as x
from fathomline.operators.fuzzy import overlap, tokens
from fathomline.operators.keys import contested, resolve_by_ids, resolve_cascade, top_per_group
from fathomline.operators.predicates import first_rule
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\.)?', ''), '/+$', '') AS bare,
       regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1) AS host,
       array_to_string(string_split(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '.')[-2:], '.') AS apex FROM pages
""")
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.bare_url("url").alias("bare"), x.host("url").alias("host"), x.apex_domain("url").alias("apex"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, 'free-bets') THEN NULL WHEN regexp_matches(url, '\?utm_[^#]*') THEN regexp_replace(url, '\?utm_[^#]*', '')
  WHEN regexp_matches(url, '#.*$') THEN regexp_replace(url, '#.*$', '') WHEN regexp_matches(url, '^http://') THEN regexp_replace(url, '^http://', 'https://') ELSE url END AS url FROM pages
""")
def url_hygiene(t: Tables) -> DataFrame:
    rules = [("free-bets", None), (r"\?utm_[^#]*", ""), ("#.*$", ""), ("^http://", "https://")]
    return t.pages.select("page_id", x.rewritten("url", rules).alias("url"))


@query(r"""
SELECT CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'director' WHEN regexp_matches(p_name, 'ring|bolt') THEN 'engineer' ELSE 'staff' END AS role, count(*) AS n FROM part GROUP BY ALL
""")
def role_classify(t: Tables) -> DataFrame:
    role = first_rule(F.col("p_name"), [("^(red|blue)", "director"), ("ring|bolt", "engineer")], F.lit("staff"))
    return t.part.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT l_suppkey, p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
s AS (SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY ALL)
SELECT l_suppkey, p_name AS topic, round(n / total, 6) AS confidence FROM v JOIN s USING (l_suppkey) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_name) = 1
""")
def majority_vote(t: Tables) -> DataFrame:
    v = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_name").agg(F.count("*").alias("n"))
    s = v.groupBy("l_suppkey").agg(F.sum("n").alias("total"))
    return top_per_group(v, "l_suppkey", [F.desc("n"), F.asc("p_name")]).join(s, "l_suppkey").select(
        "l_suppkey", F.col("p_name").alias("topic"), F.round(F.col("n") / F.col("total"), 6).alias("confidence"))


@query("""
WITH k AS (SELECT DISTINCT p_name, list_filter(list_distinct(string_split_regex(lower(p_name), '[^a-z0-9]+')), lambda w: length(w) >= 3) AS w FROM part)
SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap
FROM k a JOIN k b ON a.p_name < b.p_name AND len(list_intersect(a.w, b.w)) > 0
""")
def token_overlap_match(t: Tables) -> DataFrame:
    k = t.part.select("p_name").distinct().select("p_name", tokens("p_name", 3).alias("w"))
    a = k.select(F.col("p_name").alias("a"), F.col("w").alias("wa"), F.explode("w").alias("tok"))
    b = k.select(F.col("p_name").alias("b"), F.col("w").alias("wb"), F.explode("w").alias("tok"))
    pairs = a.join(b, "tok").where("a < b").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", F.round(overlap(F.col("wa"), F.col("wb")), 6).alias("overlap"))


_MENTIONS = """m AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'supplier#' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0')
  WHEN 1 THEN 'NATION_' || (o_custkey % 30) WHEN 2 THEN 'Supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'unknown' END AS name FROM orders)"""


@query(f"""
WITH {_MENTIONS}, exact AS (SELECT id, s_suppkey AS target FROM m JOIN supplier ON s_name = name),
lowered AS (SELECT id, s_suppkey AS target FROM m JOIN supplier ON lower(s_name) = lower(name)),
place AS (SELECT id, s_suppkey AS target FROM m JOIN nation ON n_name = name JOIN supplier ON s_nationkey = n_nationkey),
one AS (SELECT id, min(target) AS target, 0 AS rule FROM exact GROUP BY id HAVING count(DISTINCT target) = 1
  UNION ALL SELECT id, min(target), 1 FROM lowered GROUP BY id HAVING count(DISTINCT target) = 1
  UNION ALL SELECT id, min(target), 2 FROM place GROUP BY id HAVING count(DISTINCT target) = 1)
SELECT m.id, arg_min(target, rule) AS target, min(rule) AS rule FROM m LEFT JOIN one ON m.id = one.id GROUP BY m.id
""")
def resolve_names(t: Tables) -> DataFrame:
    m = t.orders.selectExpr("o_orderkey AS id", """CASE o_orderkey % 4 WHEN 0 THEN 'supplier#' || lpad(CAST(o_custkey % 100 AS STRING), 9, '0')
        WHEN 1 THEN 'NATION_' || (o_custkey % 30) WHEN 2 THEN 'Supplier#' || lpad(CAST(o_custkey AS STRING), 9, '0') ELSE 'unknown' END AS name""")
    s = t.supplier
    rules = [
        (F.col("name"), s.select(F.col("s_name").alias("value"), F.col("s_suppkey").alias("target"))),
        (F.lower("name"), s.select(F.lower("s_name").alias("value"), F.col("s_suppkey").alias("target"))),
        (F.col("name"), t.nation.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("value"), F.col("s_suppkey").alias("target"))),
    ]
    return resolve_cascade(m, "id", rules)


@query("""
WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS orcid, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 5 END AS author FROM orders)
SELECT id, coalesce(a.c_custkey, b.c_custkey) AS resolved, CASE WHEN a.c_custkey IS NOT NULL THEN 'orcid' WHEN b.c_custkey IS NOT NULL THEN 'author' END AS method
FROM m LEFT JOIN customer a ON m.orcid = a.c_name LEFT JOIN customer b ON m.author = b.c_custkey
""")
def resolve_identifiers(t: Tables) -> DataFrame:
    m = t.orders.selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END AS orcid", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 5 END AS author")
    registry = t.customer.selectExpr("c_custkey AS key", "c_name AS orcid_of", "c_custkey AS author_of")
    return resolve_by_ids(m, registry, ("orcid", "orcid_of"), ("author", "author_of"), "key", ("orcid", "author")).select("id", "resolved", "method")


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS claim, l_suppkey AS owner FROM lineitem WHERE l_quantity > 47)
SELECT claim, owner FROM c WHERE claim IN (SELECT claim FROM c GROUP BY claim HAVING count(DISTINCT owner) = 1)
""")
def contested_keys(t: Tables) -> DataFrame:
    return contested(t.lineitem.where("l_quantity > 47").selectExpr("l_partkey AS claim", "l_suppkey AS owner").distinct(), "claim", "owner")


@query(r"""
SELECT c_custkey, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fy, lower(replace(c_name, '#', '-')) AS slug, substr(sha1(lower(c_name) || '|' || lower(c_mktsegment)), 1, 16) AS key
FROM (SELECT *, make_date(CAST(1995 + c_custkey % 8 AS INTEGER), CAST(1 + c_custkey % 12 AS INTEGER), CAST(1 + c_custkey % 28 AS INTEGER)) AS d FROM customer)
""")
def keys_and_dates(t: Tables) -> DataFrame:
    told = F.format_string("%d/%d/%d", 1 + F.col("c_custkey") % 12, 1 + F.col("c_custkey") % 28, 1995 + F.col("c_custkey") % 8)
    return t.customer.withColumn("told", told).select(
        "c_custkey", x.fiscal_year(x.us_date("told")).alias("fy"), x.slug("c_name").alias("slug"), x.short_key("c_name", "c_mktsegment").alias("key"))
