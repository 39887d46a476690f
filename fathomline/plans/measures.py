"""Bibliometric measures, tiers, rankings and aggregate bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import collapsed, primary, vote, with_fallback
from fathomline.operators.keys import latest, top_per_group
from fathomline.operators.metrics import (
    area_weights, arg_max, confidence_score, dealt, h_index_of_groups, percent_rank_score, shares, tier_cut, z_composite,
)
from fathomline.operators.nested import joined_set
from fathomline.operators.predicates import token_flag
from fathomline.operators.sorting import by
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query

_WORKS = "SELECT l_suppkey AS person, p_brand AS area, l_orderkey AS work, CAST(l_quantity AS INTEGER) AS cites, l_discount AS score, l_returnflag AS conf FROM lineitem JOIN part ON l_partkey = p_partkey"


def _works(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("person"), F.col("p_brand").alias("area"), F.col("l_orderkey").alias("work"),
        F.col("l_quantity").cast("int").alias("cites"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("conf"),
    )


@query(f"""
WITH w AS ({_WORKS}), r AS (SELECT person, area, cites, row_number() OVER (PARTITION BY person, area ORDER BY cites DESC) AS k FROM w)
SELECT person, area, CAST(coalesce(max(k) FILTER (WHERE cites >= k), 0) AS BIGINT) AS h_index FROM r GROUP BY ALL
""")
def h_index_by_area(t: Tables) -> DataFrame:
    return h_index_of_groups(_works(t), ["person", "area"], "cites").select("person", "area", F.col("h_index").cast("long"))


_METRICS = f"""
WITH w AS ({_WORKS}), r AS (SELECT *, row_number() OVER (PARTITION BY person, area ORDER BY cites DESC) AS k FROM w),
m AS (SELECT person, area, count(*) AS pubs, CAST(sum(cites) AS BIGINT) AS cites, CAST(coalesce(max(k) FILTER (WHERE cites >= k), 0) AS BIGINT) AS h FROM r GROUP BY ALL)
"""


def _metrics(t: Tables) -> DataFrame:
    sums = _works(t).groupBy("person", "area").agg(F.count("*").alias("pubs"), F.sum("cites").alias("cites"))
    h = h_index_of_groups(_works(t), ["person", "area"], "cites").select("person", "area", F.col("h_index").cast("long").alias("h"))
    return sums.join(h, ["person", "area"])


@query(_METRICS + "SELECT * FROM m")
def person_area_metrics(t: Tables) -> DataFrame:
    return _metrics(t)


def _z(c: str) -> str:
    return f"coalesce(({c} - avg({c}) OVER g) / nullif(stddev_samp({c}) OVER g, 0), 0)"


@query(_METRICS + f"SELECT person, area, round({_z('pubs')} + {_z('cites')} + {_z('h')}, 6) AS composite_z FROM m WINDOW g AS (PARTITION BY area)")
def zscore_composite(t: Tables) -> DataFrame:
    return z_composite(_metrics(t), "area", ["pubs", "cites", "h"]).select("person", "area", F.round("composite_z", 6).alias("composite_z"))


_SCORED = f"""WITH w AS ({_WORKS}), s AS (SELECT person, work, area, max(coalesce(score, 0.5) * CASE conf WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.7 ELSE 0.4 END) AS score FROM w GROUP BY ALL)
"""


def _scored(t: Tables) -> DataFrame:
    w = _works(t).withColumn("confidence", F.when(F.col("conf") == "A", "high").when(F.col("conf") == "N", "medium"))
    return dealt(w, "person", rows=t.lineitem.count()).groupBy("person", "work", "area").agg(F.max(confidence_score("score", "confidence")).alias("score"))


@query(_SCORED + "SELECT person, work, area, round(score, 6) AS score FROM s")
def publication_area_scores(t: Tables) -> DataFrame:
    return _scored(t).withColumn("score", F.round("score", 6))


_WEIGHTS = _SCORED + """, n AS (SELECT person, count(DISTINCT work) AS works FROM s GROUP BY ALL),
g AS (SELECT person, area, round(sum(score) / greatest(any_value(works), 1), 4) AS weight, count(DISTINCT work) AS evidence FROM s JOIN n USING (person) GROUP BY ALL)
"""


@query(_WEIGHTS + "SELECT person, area, round(weight, 3) AS weight, evidence FROM g")
def area_weighted_scores(t: Tables) -> DataFrame:
    return area_weights(_scored(t), "person", "work", "area", "score").withColumn("weight", F.round("weight", 3))


@query(_WEIGHTS + "SELECT person, area, evidence FROM g WHERE evidence >= 2 QUALIFY row_number() OVER (PARTITION BY person ORDER BY evidence DESC, area) <= 3")
def person_area_topn(t: Tables) -> DataFrame:
    found = area_weights(_scored(t), "person", "work", "area", "score", least_evidence=2)
    return top_per_group(found, "person", [F.desc("evidence"), F.asc("area")], 3).select("person", "area", "evidence")


_VOTE = """
WITH direct AS (SELECT DISTINCT s_suppkey AS owner, p_brand AS area FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49),
thru AS (SELECT l_suppkey AS owner, p_brand AS area, CAST(l_linenumber AS DOUBLE) AS weight, CAST(l_quantity AS INTEGER) % 4 AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount = 0.1),
votes AS (SELECT owner, area, 2.0 AS v FROM direct UNION ALL SELECT owner, area, weight * greatest(evidence, 1) FROM thru),
totals AS (SELECT owner, area, sum(v)::DOUBLE AS total FROM votes GROUP BY ALL),
prim AS (SELECT owner, area, total FROM totals QUALIFY row_number() OVER (PARTITION BY owner ORDER BY total DESC, area) = 1)
"""


def _votes(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    direct = rows.where("l_quantity >= 49").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("owner"), F.col("p_brand").alias("area")).distinct()
    through = rows.where("l_discount = 0.1").select(
        F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("area"), F.col("l_linenumber").cast("double").alias("weight"), (F.col("l_quantity").cast("int") % 4).alias("evidence"))
    return vote(direct, through, "owner", "area")


@query(_VOTE + "SELECT * FROM prim")
def primary_group_vote(t: Tables) -> DataFrame:
    return primary(_votes(t), "owner", "area")


@query(_VOTE + """
, inherited AS (SELECT s_suppkey AS owner, 'Brand#' || (s_nationkey + 1) AS area FROM supplier WHERE s_nationkey < 20)
SELECT s_suppkey AS owner, coalesce(CASE WHEN total >= 40 THEN prim.area END, inherited.area) AS area,
       CASE WHEN total >= 40 THEN 'own' WHEN inherited.area IS NOT NULL THEN 'inherited' END AS source
FROM supplier LEFT JOIN prim ON s_suppkey = prim.owner LEFT JOIN inherited ON s_suppkey = inherited.owner
""")
def primary_fallback(t: Tables) -> DataFrame:
    own = primary(_votes(t), "owner", "area").where("total >= 40")
    inherited = t.supplier.where("s_nationkey < 20").selectExpr("s_suppkey AS owner", "'Brand#' || (s_nationkey + 1) AS area")
    return with_fallback(t.supplier.select(F.col("s_suppkey").alias("owner")), own, "owner", inherited, "area")


@query("""
WITH n AS (SELECT s_nationkey AS g, count(*) AS n FROM supplier GROUP BY ALL),
least_n AS (SELECT quantile_disc(n, 0.5) AS k FROM n),
m AS (SELECT s_suppkey, CASE WHEN n.n < (SELECT k FROM least_n) THEN 100 + n_regionkey ELSE s_nationkey END AS area
      FROM supplier JOIN n ON s_nationkey = g JOIN nation ON s_nationkey = n_nationkey)
SELECT area, count(*) AS members FROM m GROUP BY ALL
""")
def collapse_small_groups(t: Tables) -> DataFrame:
    sizes = [r["count"] for r in t.supplier.groupBy("s_nationkey").count().orderBy("count").collect()]
    least = sizes[max(0, -(-len(sizes) // 2) - 1)]
    parents = {r.n_nationkey: 100 + r.n_regionkey for r in t.nation.collect()}
    assigned = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("area"))
    return collapsed(assigned, "area", parents, least).groupBy("area").agg(F.count("*").alias("members"))


@query(f"""
WITH w AS ({_WORKS}), g AS (SELECT area, person, count(*) AS n FROM w GROUP BY ALL)
SELECT area, person, n, row_number() OVER (PARTITION BY area ORDER BY n DESC, person) AS rank FROM g QUALIFY rank <= 10
""")
def top_facilities_per_area(t: Tables) -> DataFrame:
    g = _works(t).groupBy("area", "person").agg(F.count("*").alias("n"))
    return top_per_group(g, "area", [F.desc("n"), F.asc("person")], 10, rank="rank").withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT p_brand, p_partkey FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END DESC NULLS LAST, p_name, p_partkey) <= 10
""")
def top_products_nulls_last(t: Tables) -> DataFrame:
    priced = t.part.withColumn("v", F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")))
    return top_per_group(priced, "p_brand", [by("v", True), F.col("p_name"), F.col("p_partkey")], 10).select("p_brand", "p_partkey")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_verdict(t: Tables) -> DataFrame:
    return latest(t.events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("""
WITH l AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 20) AS passed, count(*) FILTER (WHERE value < 1) AS not_applicable,
       round(count(*) FILTER (WHERE value > 20) / nullif(count(*) FILTER (WHERE value >= 1), 0), 6) AS rate FROM l GROUP BY ALL
""")
def verdict_summary(t: Tables) -> DataFrame:
    found = latest(t.events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return found.groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("value") > 20).alias("passed"), F.count_if(F.col("value") < 1).alias("not_applicable"),
        F.round(F.try_divide(F.count_if(F.col("value") > 20), F.count_if(F.col("value") >= 1)), 6).alias("rate"),
    )


_RANKED = """
WITH o AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT c_custkey, round(0.6 * percent_rank() OVER (ORDER BY n) + 0.4 * percent_rank() OVER (ORDER BY c_acctbal), 9) AS score FROM o)
"""


def _ranked(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    base = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_acctbal", F.coalesce("n", F.lit(0)).alias("n"))
    return percent_rank_score(base, {"n": 0.6, "c_acctbal": 0.4}).select("c_custkey", F.round("score", 9).alias("score"))


@query(_RANKED + "SELECT * FROM s")
def percent_rank_tier(t: Tables) -> DataFrame:
    return _ranked(t)


@query(_RANKED + """
, p AS (SELECT *, c_custkey % 97 = 0 AS pinned FROM s), k AS (SELECT greatest(100, count(*) FILTER (WHERE pinned)) AS k FROM p)
SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY pinned DESC, score DESC, c_custkey) <= (SELECT k FROM k) THEN 'core' ELSE 'archive' END AS tier FROM p
""")
def tier_pinned(t: Tables) -> DataFrame:
    scored = _ranked(t).withColumn("pinned", F.col("c_custkey") % 97 == 0)
    return tier_cut(scored, "score", "pinned", 100, "c_custkey").select("c_custkey", "tier")


@query("""
WITH i AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name END AS orcid, CASE WHEN c_nationkey < 10 THEN c_nationkey END AS ror, c_mktsegment AS openalex FROM customer)
SELECT 'orcid' AS identifier, count(orcid) AS n FROM i UNION ALL SELECT 'ror', count(ror) FROM i UNION ALL SELECT 'openalex', count(openalex) FROM i
""")
def identifier_coverage(t: Tables) -> DataFrame:
    i = t.customer.selectExpr("CASE WHEN c_custkey % 3 = 0 THEN c_name END AS orcid", "CASE WHEN c_nationkey < 10 THEN c_nationkey END AS ror", "c_mktsegment AS openalex")
    return i.agg(*(F.count(c).alias(c) for c in i.columns)).select(F.expr("stack(3, 'orcid', orcid, 'ror', ror, 'openalex', openalex) AS (identifier, n)"))


@query("""
SELECT count(*) FILTER (WHERE c_nationkey < 10 AND c_acctbal > 0) AS both_flags, CAST(sum(CASE WHEN c_nationkey < 10 THEN 1 ELSE 0 END) AS DOUBLE) AS site,
       count(*) FILTER (WHERE c_acctbal > 0) AS scholar FROM customer
""")
def cohort_overlap(t: Tables) -> DataFrame:
    flags = t.customer.select(F.concat_ws(", ", F.when(F.col("c_nationkey") < 10, "site"), F.when(F.col("c_acctbal") > 0, "scholar")).alias("cohorts"))
    site, scholar = token_flag("cohorts", "site"), token_flag("cohorts", "scholar")
    return flags.agg(F.count_if(site & scholar).alias("both_flags"), F.sum(F.when(site, 1).otherwise(0)).cast("double").alias("site"), F.count_if(scholar).alias("scholar"))


@query("""
SELECT c_mktsegment AS tier, count(*) AS n, round(avg(c_acctbal), 1) AS mean_balance, count(DISTINCT c_nationkey) AS countries FROM customer GROUP BY ALL
""")
def registry_tiers(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_mktsegment").alias("tier")).agg(
        F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 1).alias("mean_balance"), F.countDistinct("c_nationkey").alias("countries"))


@query("""
SELECT p_brand, arg_max(CASE WHEN p_size > 3 THEN p_name || '/' || p_partkey END, p_retailprice + p_partkey / 1e6) AS title FROM part GROUP BY ALL
""")
def arg_max_title(t: Tables) -> DataFrame:
    named = t.part.selectExpr("p_brand", "CASE WHEN p_size > 3 THEN p_name || '/' || p_partkey END AS title", "p_retailprice + p_partkey / 1e6D AS k")
    return named.groupBy("p_brand").agg(arg_max("title", "k").alias("title"))


@query("""
WITH m AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
top AS (SELECT l_suppkey, l_returnflag FROM m QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1)
SELECT l.l_suppkey, any_value(top.l_returnflag) AS usual_flag, min(l_shipdate) AS first_date, max(l_shipdate) AS last_date, count(DISTINCT l_orderkey) AS works
FROM lineitem l JOIN top USING (l_suppkey) GROUP BY ALL
""")
def mode_bundle(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    top = top_per_group(counts, "l_suppkey", [F.desc("n"), F.asc("l_returnflag")]).select("l_suppkey", F.col("l_returnflag").alias("usual_flag"))
    rest = t.lineitem.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_date"), F.max("l_shipdate").alias("last_date"), F.countDistinct("l_orderkey").alias("works"))
    return rest.join(top, "l_suppkey")


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag || l_linestatus, '; ' ORDER BY l_returnflag || l_linestatus) AS flags FROM lineitem GROUP BY ALL")
def string_agg_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(joined_set(F.concat("l_returnflag", "l_linestatus"), "; ").alias("flags"))


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 6) AS share FROM customer GROUP BY ALL")
def group_shares(t: Tables) -> DataFrame:
    return shares(t.customer, "c_mktsegment", "c_acctbal").select("c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), F.round("share", 6).alias("share"))


@query("""
WITH n AS (SELECT p_type, p_brand, count(*) AS c FROM part GROUP BY ALL), k AS (SELECT p_brand, count(*) AS kinds FROM n WHERE c > 12 GROUP BY ALL)
SELECT CASE WHEN kinds = 1 THEN 'Other' ELSE p_brand END AS category, CAST(sum(kinds) AS BIGINT) AS kinds FROM k GROUP BY ALL
""")
def pooled_categories(t: Tables) -> DataFrame:
    k = t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("c")).where("c > 12").groupBy("p_brand").agg(F.count("*").alias("kinds"))
    return k.groupBy(F.when(F.col("kinds") == 1, "Other").otherwise(F.col("p_brand")).alias("category")).agg(F.sum("kinds").alias("kinds"))


@query("""
WITH a AS (SELECT p_brand AS area, count(DISTINCT l_suppkey) AS facilities, count(DISTINCT o_custkey) AS people
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
c AS (SELECT p_brand AS area, s_nationkey, count(DISTINCT s_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
m AS (SELECT area, max(n) AS most FROM c GROUP BY ALL)
SELECT area, facilities < 50 AS few_facilities, most > 0.85 * facilities AS one_country, people < 0.4 * facilities AS few_people FROM a JOIN m USING (area)
""")
def gap_flags(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("area"), "l_suppkey", "l_orderkey")
    people = rows.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("area").agg(F.countDistinct("l_suppkey").alias("facilities"), F.countDistinct("o_custkey").alias("people"))
    per = rows.select("area", "l_suppkey").distinct().join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("area", "s_nationkey").agg(F.count("*").alias("n"))
    return people.join(per.groupBy("area").agg(F.max("n").alias("most")), "area").select(
        "area", (F.col("facilities") < 50).alias("few_facilities"), (F.col("most") > 0.85 * F.col("facilities")).alias("one_country"), (F.col("people") < 0.4 * F.col("facilities")).alias("few_people"))


@query("""
SELECT r_name, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS "BUILDING", count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "MACHINERY"
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL
""")
def pivot_segments(t: Tables) -> DataFrame:
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return place.groupBy("r_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count().na.fill(0)


@query("""
WITH s AS (SELECT l_suppkey, l_orderkey, count(*) AS hits FROM lineitem GROUP BY ALL)
SELECT l_suppkey, CAST(sum(greatest(1, round_even(hits / 2, 0))) AS BIGINT) AS halved FROM s GROUP BY ALL
""")
def halved_tally(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("hits"))
    return s.groupBy("l_suppkey").agg(F.sum(F.greatest(F.lit(1), F.bround(F.col("hits") / 2))).cast("long").alias("halved"))
