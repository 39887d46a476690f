"""Loads, facets, sort modes, resolvers, overlays and parsers that the other modules don't hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import angles, yearly_amounts
from fathomline.operators.graph import checkpoints
from fathomline.operators.keys import latest
from fathomline.operators.spatial import farthest_points, nearest, polygon_join
from fathomline.plans.define import Plans, Tables
from fathomline.plans.space import _KM, _PLACE

PLANS = Plans()
query = PLANS.query


# Weights and counts.


@query("SELECT l_suppkey AS person, l_partkey % 10 AS area, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_suppkey) AS weight FROM (SELECT DISTINCT l_suppkey, l_partkey % 10 AS l_partkey FROM lineitem)")
def inherited_area_weights(t: Tables) -> DataFrame:
    base = t.lineitem.select(F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 10).alias("area")).distinct()
    each = base.groupBy(F.col("person").alias("p")).agg(F.count("*").alias("n"))
    return base.join(each, F.col("person") == F.col("p")).select("person", "area", (F.lit(1.0) / F.col("n")).alias("weight"))


@query("""
SELECT n_nationkey AS area, coalesce(o.n, 0) + 3.0::DOUBLE * coalesce(s.n, 0) + 1.5::DOUBLE * coalesce(d.n, 0) + 0.35::DOUBLE * coalesce(p.n, 0) AS weight
FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL) o ON o.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) s ON s.k = n_nationkey
LEFT JOIN (SELECT p_size % 25 AS k, count(*) AS n FROM part GROUP BY ALL) d ON d.k = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) p ON p.k = n_nationkey
""")
def area_composite_weight(t: Tables) -> DataFrame:
    branches = [
        (1.0, t.customer.select(F.col("c_nationkey").alias("k")).groupBy("k").agg(F.count("*").alias("n"))),
        (3.0, t.supplier.select(F.col("s_nationkey").alias("k")).groupBy("k").agg(F.count("*").alias("n"))),
        (1.5, t.part.select((F.col("p_size") % 25).alias("k")).groupBy("k").agg(F.count("*").alias("n"))),
        (0.35, t.orders.select("o_custkey").distinct().join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))),
    ]
    parts = reduce(DataFrame.unionAll, (b.select("k", (F.col("n") * w).alias("v")) for w, b in branches))
    sums = parts.groupBy("k").agg(F.sum("v").alias("v"))
    return t.nation.join(sums, F.col("n_nationkey") == F.col("k"), "left").select(F.col("n_nationkey").alias("area"), F.round(F.coalesce("v", F.lit(0.0)), 6).alias("weight"))


PLANS.oracles["area_composite_weight"] = "SELECT area, round(weight, 6) AS weight FROM (" + PLANS.oracles["area_composite_weight"] + ")"


@query("""
SELECT count(*) FILTER (WHERE o.k IS NOT NULL) AS sited, count(*) FILTER (WHERE o.k IS NULL AND c_mktsegment = 'BUILDING') AS domain,
  count(*) FILTER (WHERE o.k IS NULL AND c_mktsegment IS DISTINCT FROM 'BUILDING') AS unplaced
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey
""")
def placement_counts(t: Tables) -> DataFrame:
    placed = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    rows = t.customer.join(placed, F.col("c_custkey") == F.col("k"), "left")
    home = F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False))
    return rows.agg(F.count_if(F.col("k").isNotNull()).alias("sited"), F.count_if(F.col("k").isNull() & home).alias("domain"), F.count_if(F.col("k").isNull() & ~home).alias("unplaced"))


@query("SELECT o_orderpriority, count(DISTINCT l_suppkey) AS facilities FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def nested_facility_counts(t: Tables) -> DataFrame:
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("held"))
    flat = t.orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", F.explode("held").alias("f")).distinct()
    return flat.groupBy("o_orderpriority").agg(F.count("f").alias("facilities"))


# Loads.


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) ELSE c_acctbal END AS c_acctbal FROM customer")
def correlated_update(t: Tables) -> DataFrame:
    best = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.lit(True).alias("there"))
    return t.customer.join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.when(F.col("there"), F.col("top")).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query("""
SELECT left(sha256(concat_ws('|', l_suppkey, l_orderkey, l_linenumber, year(l_shipdate))), 16) AS event_id, l_suppkey AS funder_id, l_orderkey AS facility_id,
  CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, l_extendedprice AS amount_usd, 'legacy-links' AS source
FROM lineitem WHERE l_extendedprice IS NOT NULL
""")
def migrated_events(t: Tables) -> DataFrame:
    year = F.year("l_shipdate")
    key = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_suppkey", "l_orderkey", "l_linenumber")), year.cast("string")), 256)
    return t.lineitem.where("l_extendedprice IS NOT NULL").select(
        F.left(key, F.lit(16)).alias("event_id"), F.col("l_suppkey").alias("funder_id"), F.col("l_orderkey").alias("facility_id"),
        year.alias("fiscal_year"), F.col("l_extendedprice").alias("amount_usd"), F.lit("legacy-links").alias("source"))


_FIXES = "page_id * 3 AS id, 'Customer#' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS name, CASE page_id % 3 WHEN 0 THEN 'facility-home' WHEN 1 THEN 'archive' ELSE 'product' END AS kind, CASE page_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence"


@query(f"""
SELECT kind, confidence, count(*) AS n, count(*) FILTER (WHERE i.c_custkey IS NOT NULL) AS by_id, count(*) FILTER (WHERE i.c_custkey IS NULL AND m.c_custkey IS NOT NULL) AS by_name
FROM (SELECT {_FIXES} FROM pages) u LEFT JOIN customer i ON i.c_custkey = u.id LEFT JOIN (SELECT c_name, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL) m ON m.c_name = u.name
WHERE NOT (kind = 'facility-home' AND confidence = 'low') AND coalesce(i.c_custkey, m.c_custkey) IS NOT NULL GROUP BY ALL
""")
def url_fixes(t: Tables) -> DataFrame:
    fixes = t.pages.selectExpr(
        "page_id * 3 AS id", "concat('Customer#', lpad(CAST(page_id AS STRING), 9, '0')) AS name",
        "CASE page_id % 3 WHEN 0 THEN 'facility-home' WHEN 1 THEN 'archive' ELSE 'product' END AS kind",
        "CASE page_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence")
    by_id = t.customer.select(F.col("c_custkey").alias("own"))
    by_name = t.customer.groupBy(F.col("c_name").alias("n")).agg(F.min("c_custkey").alias("named"))
    found = fixes.join(by_id, F.col("id") == F.col("own"), "left").join(by_name, F.col("name") == F.col("n"), "left")
    kept = found.where("NOT (kind = 'facility-home' AND confidence = 'low') AND coalesce(own, named) IS NOT NULL")
    return kept.groupBy("kind", "confidence").agg(
        F.count("*").alias("n"), F.count_if(F.col("own").isNotNull()).alias("by_id"), F.count_if(F.col("own").isNull() & F.col("named").isNotNull()).alias("by_name"))


@query("""
WITH good AS (SELECT user_id, value, event_type FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL AND user_id IN (SELECT c_custkey FROM customer)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey, coalesce(value, c_acctbal) AS c_acctbal, coalesce(event_type, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN good ON user_id = c_custkey
""")
def validated_upsert(t: Tables) -> DataFrame:
    good = t.events.where("value IS NOT NULL AND event_type IS NOT NULL").join(t.customer, F.col("user_id") == F.col("c_custkey"), "left_semi")
    last = latest(good, "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "value", "event_type")
    return t.customer.join(last, F.col("c_custkey") == F.col("user_id"), "left").select(
        "c_custkey", F.coalesce("value", "c_acctbal").alias("c_acctbal"), F.coalesce("event_type", "c_mktsegment").alias("c_mktsegment"))


#: Sample rows (nation name, pattern of a customer's name, amount).
_SAMPLES = [("NATION_3", "%#00000000_", 100.0), ("NATION_9", "%0000007", 50.0), ("NATION_20", "customer#%11", 25.0), ("ATLANTIS", "%1", 1.0), ("NATION_5", "nobody%", 2.0)]


@query(f"""
WITH s(nation, pattern, amount) AS (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in _SAMPLES)}),
r AS (SELECT n_nationkey AS funder, min(c_custkey) AS facility, any_value(amount)::DOUBLE AS amount FROM s JOIN nation ON n_name = nation JOIN customer ON c_name ILIKE pattern GROUP BY n_nationkey, pattern)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = facility AND c_nationkey = funder)
""")
def sample_rows(t: Tables) -> DataFrame:
    found = None
    for nation, pattern, amount in _SAMPLES:
        one = t.customer.where(F.col("c_name").ilike(pattern)).agg(F.min("c_custkey").alias("facility")).where("facility IS NOT NULL")
        one = one.select(F.lit(nation).alias("nation"), "facility", F.lit(amount).alias("amount"))
        found = one if found is None else found.unionAll(one)
    rows = found.join(t.nation, F.col("nation") == F.col("n_name")).select(F.col("n_nationkey").alias("funder"), "facility", "amount")
    return rows.join(t.customer, (F.col("facility") == F.col("c_custkey")) & (F.col("funder") == F.col("c_nationkey")), "left_anti")


# Facets and sort modes.


@query("""
SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags, list(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY ALL)
WHERE list_has_any(flags, ['R', 'A']) AND list_has_any(states, ['O'])
""")
def feature_facets(t: Tables) -> DataFrame:
    features = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"))
    facets = {"flags": ["R", "A"], "states": ["O"]}
    return features.where(reduce(lambda a, b: a & b, (F.arrays_overlap(c, F.array(*map(F.lit, v))) for c, v in facets.items()))).select("l_orderkey")


def by_status(column: str, mode: str, machine: tuple[str, ...]):
    """The condition of a facet whose values may be 'machine' (any of a kind), 'none' (absent) or one exact value."""
    c = F.col(column)
    return c.isin(*machine) if mode == "machine" else c.isNull() | (c == "") if mode == "none" else c == mode


_MODES = ("machine", "none", "3-MEDIUM")


@query("SELECT mode, count(o_orderkey) AS n FROM (VALUES ('machine'), ('none'), ('3-MEDIUM')) m(mode) LEFT JOIN orders ON CASE mode WHEN 'machine' THEN o_orderpriority IN ('1-URGENT', '2-HIGH') WHEN 'none' THEN o_orderpriority IS NULL OR o_orderpriority = '' ELSE o_orderpriority = mode END GROUP BY ALL")
def enum_filter(t: Tables) -> DataFrame:
    counts = (F.count_if(by_status("o_orderpriority", m, ("1-URGENT", "2-HIGH"))).alias(m) for m in _MODES)
    return t.orders.agg(*counts).unpivot([], list(_MODES), "mode", "n")


_CARDS = """
SELECT c_custkey AS k, c_name AS name, c_nationkey AS country, c_acctbal AS balance, coalesce(a, 0) AS a, coalesce(p, 0) AS p, coalesce(s, 0) AS s, coalesce(f, 0) AS f
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS a, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderstatus) AS s, round(sum(o_totalprice), 2) AS f FROM orders GROUP BY ALL) ON o_custkey = c_custkey
"""
#: The browse view's sort modes, and the weights of its composite score.
_SCORE = "3 * a + 2 * p + 2 * s + a + 5 * log10(f + 1) + 2 * CASE WHEN balance > 5000 THEN 1 ELSE 0 END"
SORTS = {
    "name": ("name",), "name_desc": ("name DESC",), "country": ("country", "name"), "areas": ("a DESC", "name"), "people": ("p DESC", "name"),
    "funding": ("f DESC", "name"), "score": (f"round({_SCORE}, 6) DESC", "name"),
}
PEOPLE_SORTS = {"name": ("name",), "orders": ("a DESC", "name"), "funding": ("f DESC", "name"), "balance": ("balance DESC NULLS LAST", "name"), "country": ("country", "name"), "mean": ("round(f / greatest(a, 1), 6) DESC", "name")}


def _top_sql(sorts: dict, most: int) -> str:
    return f"WITH c AS ({_CARDS}) " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m}' AS mode, row_number() OVER (ORDER BY {', '.join((*o, 'k'))}) AS place, k FROM c) WHERE place <= {most}" for m, o in sorts.items())


def _tops(t: Tables, sorts: dict, most: int) -> DataFrame:
    """(mode, place, k): the first cards by each mode; cards are made once, and a mode is a top-k without a full sort."""
    made = t.orders.groupBy("o_custkey").agg(F.count("*").alias("a"), F.countDistinct("o_orderpriority").alias("p"), F.countDistinct("o_orderstatus").alias("s"), F.round(F.sum("o_totalprice"), 2).alias("f"))
    cards = t.customer.join(made, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"), F.col("c_acctbal").alias("balance"), *(F.coalesce(c, F.lit(0)).alias(c) for c in "apsf"))
    checkpoints(t.spark)
    cards = cards.checkpoint()  # once for all modes
    out = None
    for mode, order in sorts.items():
        ordered = [F.expr(c.split(" DESC")[0]).desc_nulls_last() if " DESC" in c else F.col(c) for c in order]
        top = cards.orderBy(*ordered, "k").limit(most)
        place = F.row_number().over(Window.orderBy(*ordered, "k"))
        one = top.select(F.lit(mode).alias("mode"), place.cast("long").alias("place"), "k")
        out = one if out is None else out.unionAll(one)
    return out


@query(_top_sql(SORTS, 20))
def browse_sorts(t: Tables) -> DataFrame:
    return _tops(t, SORTS, 20)


@query(_top_sql(PEOPLE_SORTS, 20))
def people_sorts(t: Tables) -> DataFrame:
    return _tops(t, PEOPLE_SORTS, 20)


# Resolvers and checks.


@query("""
WITH h AS (SELECT o_custkey AS id, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS name, count(*) AS works, count(*) FILTER (WHERE o_orderstatus = 'F') + 1 AS hits FROM orders GROUP BY o_custkey)
SELECT id, name, least(hits, works)::DOUBLE / works AS share FROM h
WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def harvest_dedupe(t: Tables) -> DataFrame:
    held = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("works"), (F.count_if(F.col("o_orderstatus") == "F") + 1).alias("hits"))
    held = held.withColumn("name", F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 2).cast("string"), 9, "0")))
    by_id, by_name = t.customer.where("c_acctbal > 0").select("c_custkey"), t.customer.where("c_mktsegment = 'BUILDING'").select("c_name")
    new = held.join(by_id, F.col("id") == F.col("c_custkey"), "left_anti").join(by_name, F.col("name") == F.col("c_name"), "left_anti")
    return new.select("id", "name", (F.least("hits", "works") / F.col("works")).alias("share"))


@query("""
WITH p AS (SELECT c_custkey AS person, c_custkey % 40 AS family, c_custkey % 7 AS given, c_nationkey AS institution FROM customer),
a AS (SELECT s_suppkey AS author, s_suppkey % 40 AS family, s_suppkey % 5 AS given, s_nationkey AS institution, s_acctbal < 0 AS stub FROM supplier),
m AS (SELECT person, author, p.institution = a.institution AS home FROM p JOIN a USING (family) WHERE NOT stub AND (p.given = a.given OR a.given = 0)),
c AS (SELECT person, count(*) AS n, count(*) FILTER (WHERE home) AS h, min(author) AS only_one, min(author) FILTER (WHERE home) AS at_home FROM m GROUP BY person)
SELECT person, CASE WHEN h = 1 THEN at_home WHEN h = 0 AND n = 1 THEN only_one END AS author, CASE WHEN h = 1 THEN 'institution' WHEN h > 1 THEN 'ambiguous' WHEN n = 1 THEN 'single' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS rule
FROM p LEFT JOIN c USING (person)
""")
def author_resolver(t: Tables) -> DataFrame:
    """Family names equal, given names compatible, no stub; then one author of the person's institution, else the only one."""
    people = t.customer.selectExpr("c_custkey AS person", "c_custkey % 40 AS family", "c_custkey % 7 AS given", "c_nationkey AS institution")
    authors = t.supplier.where("NOT s_acctbal < 0").selectExpr("s_suppkey AS author", "s_suppkey % 40 AS f", "s_suppkey % 5 AS g", "s_nationkey AS i")
    # people and authors meet as kinds of equal names, by the person's given name and by none, so no pair of them is made
    of = authors.groupBy("f", "g").agg(F.count("*").alias("n"), F.min("author").alias("one"))
    at = authors.groupBy("f", "g", "i").agg(F.count("*").alias("h"), F.min("author").alias("at_home"))
    kinds = people.select("family", "given", "institution").distinct().withColumn("g", F.explode(F.array_distinct(F.array(F.col("given"), F.lit(0).cast("long")))))
    met = kinds.join(of, (F.col("family") == F.col("f")) & (kinds.g == of.g)).drop(of.f, of.g).join(
        at, (kinds.family == at.f) & (kinds.g == at.g) & (kinds.institution == at.i), "left")
    found = met.groupBy("family", "given", "institution").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"), F.min("one").alias("one"), F.min("at_home").alias("at_home"))
    same = [people[c].eqNullSafe(found[c]) for c in ("family", "given", "institution")]
    return people.join(found, same, "left").selectExpr(
        "person", "CASE WHEN h = 1 THEN at_home WHEN h = 0 AND n = 1 THEN one END AS author",
        "CASE WHEN h = 1 THEN 'institution' WHEN h > 1 THEN 'ambiguous' WHEN n = 1 THEN 'single' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS rule")


#: Spellings of a boolean in text tables, and roles of key personnel.
TRUE_WORDS, FALSE_WORDS = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")
KEY_ROLES = ("AUTOMOBILE", "BUILDING")
_SAID = "CASE c_custkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '0' WHEN 3 THEN 'no' WHEN 4 THEN '' WHEN 5 THEN 'maybe' END"


@query(f"""
SELECT c_custkey, CASE WHEN lower(trim(said)) IN {TRUE_WORDS} THEN true WHEN lower(trim(said)) IN {FALSE_WORDS} THEN false ELSE coalesce(c_mktsegment IN {KEY_ROLES}, false) END AS is_key
FROM (SELECT *, {_SAID} AS said FROM customer)
""")
def key_personnel(t: Tables) -> DataFrame:
    said = F.lower(F.trim(F.expr(_SAID)))
    return t.customer.select("c_custkey", F.when(said.isin(*TRUE_WORDS), True).when(said.isin(*FALSE_WORDS), False).otherwise(
        F.coalesce(F.col("c_mktsegment").isin(*KEY_ROLES), F.lit(False))).alias("is_key"))


#: Curated wipes (segment, nation or null for all, whether the balance goes, evidence).
_WIPES = [("FURNITURE", 3, True, "namesake"), ("MACHINERY", None, False, "merged record"), ("HOUSEHOLD", 7, True, "wrong person")]


@query(f"""
WITH w(segment, nation, wipe, evidence) AS (VALUES {', '.join(f"('{a}', {b if b is not None else 'NULL'}, {c}, '{d}')" for a, b, c, d in _WIPES)})
SELECT c_custkey, CASE WHEN wipe THEN NULL ELSE c_acctbal END AS c_acctbal, evidence AS provenance
FROM customer LEFT JOIN w ON segment = c_mktsegment AND (nation IS NULL OR nation = c_nationkey)
""")
def curated_wipes(t: Tables) -> DataFrame:
    wipes = t.spark.createDataFrame(_WIPES, "segment string, nation int, wipe boolean, evidence string")
    on = (F.col("segment") == F.col("c_mktsegment")) & (F.col("nation").isNull() | (F.col("nation") == F.col("c_nationkey")))
    return t.customer.join(F.broadcast(wipes), on, "left").select(  # three rows
        "c_custkey", F.when(F.col("wipe"), None).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.col("evidence").alias("provenance"))


#: Figures of a report (token, SQL, expected).
_FIGURES = [("regions", "SELECT count(*) FROM region", 5), ("nations", "SELECT count(*) FROM nation", 25), ("late", "SELECT count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-12-01'", 0)]


@query(" UNION ALL ".join(f"SELECT '{k}' AS token, CAST({n} AS BIGINT) AS expected, ({s}) AS found, ({s}) = {n} AS ok" for k, s, n in _FIGURES))
def report_figures(t: Tables) -> DataFrame:
    """Each figure of a report beside what its SQL gives now."""
    from fathomline.sources.catalog import Catalog

    tables = Catalog(t.spark, t.dir)
    each = (tables.sql(f"SELECT '{k}' AS token, CAST({n} AS BIGINT) AS expected, ({s}) AS found") for k, s, n in _FIGURES)
    return reduce(DataFrame.unionAll, each).withColumn("ok", F.col("found") == F.col("expected"))


@query("""
WITH a AS (SELECT c_nationkey AS x, s_nationkey AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
e AS (SELECT least(x, y) AS a, greatest(x, y) AS b, 'trade' AS source, count(*) AS w FROM a WHERE x <> y GROUP BY ALL
  UNION ALL SELECT m.n_nationkey, n.n_nationkey, 'region', 1 FROM nation m JOIN nation n ON m.n_regionkey = n.n_regionkey AND m.n_nationkey < n.n_nationkey)
SELECT a, m.n_name AS label_a, b, n.n_name AS label_b, CAST(sum(w) AS BIGINT) AS weight, count(*) AS sources FROM e JOIN nation m ON m.n_nationkey = a JOIN nation n ON n.n_nationkey = b GROUP BY ALL
""")
def assembled_graph(t: Tables) -> DataFrame:
    sold = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    trade = sold.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").alias("w"))
    m = t.nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("label_a"), F.col("n_regionkey").alias("ra"))
    n = t.nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("label_b"), F.col("n_regionkey").alias("rb"))
    region = m.join(n, (F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1).cast("long").alias("w"))
    edges = trade.unionByName(region).groupBy("a", "b").agg(F.sum("w").alias("weight"), F.count("*").alias("sources"))
    return edges.join(m.drop("ra"), "a").join(n.drop("rb"), "b").select("a", "label_a", "b", "label_b", "weight", "sources")


# Overlays and places.


@query("SELECT p_brand AS name, count(*) AS fragments, min(p_size) AS west, max(p_size) + 1 AS east FROM part GROUP BY p_brand")
def merged_fragments(t: Tables) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("p_size") + dx).alias("x"), F.lit(dy).alias("y"))
    fragments = t.part.select(F.col("p_brand").alias("name"), F.array(F.array(F.array(at(0, 0), at(1, 0), at(0, 1)))).alias("polygons"))
    shapes = fragments.groupBy("name").agg(F.flatten(F.collect_list("polygons")).alias("polygons"))
    every = F.flatten(F.flatten("polygons"))
    return shapes.select("name", F.size("polygons").cast("long").alias("fragments"), F.array_min(F.transform(every, lambda p: p["x"])).alias("west"), F.array_max(F.transform(every, lambda p: p["x"])).alias("east"))


@query("""
WITH g AS (SELECT s_nationkey AS k, min(s_name) AS manager, max(s_acctbal) AS score FROM supplier GROUP BY ALL)
SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' AND manager IS NOT NULL THEN manager ELSE coalesce(nullif(c_mktsegment, 'BUILDING'), manager) END AS manager,
  upper(regexp_replace(c_name, '[^A-Z0-9]', '', 'g')) AS acronym FROM customer LEFT JOIN g ON k = c_nationkey
""")
def enriched_attributes(t: Tables) -> DataFrame:
    given = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("manager"))
    forced = (F.col("c_mktsegment") == "FURNITURE") & F.col("manager").isNotNull()
    own = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.join(given, F.col("c_nationkey") == F.col("k"), "left").select(
        "c_custkey", F.when(forced, F.col("manager")).otherwise(F.coalesce(own, "manager")).alias("manager"), F.upper(F.regexp_replace("c_name", "[^A-Z0-9]", "")).alias("acronym"))


@query("SELECT host, max(struct_pack(y := y, url := url)).url AS url, max(y) AS version FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS y, url FROM pages) WHERE y IS NOT NULL GROUP BY host")
def latest_boundary(t: Tables) -> DataFrame:
    rows = t.pages.select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS INT)").alias("y"), "url").where("y IS NOT NULL")
    top = rows.groupBy("host").agg(F.max(F.struct("y", "url")).alias("b"))
    return top.select("host", "b.url", F.col("b.y").alias("version"))


#: Areas that a kind of region starts with.
_SEEDS = {0: (1, 7, 60), 1: (2, 7), 2: (3, 99), 3: (), 4: (5, 11, 13)}


@query(f"WITH s(kind, area) AS (VALUES {', '.join(f'({k}, {a})' for k, v in _SEEDS.items() for a in v)}) SELECT n_nationkey AS region, area FROM nation JOIN s ON kind = n_regionkey WHERE area IN (SELECT p_size FROM part)")
def seeded_areas(t: Tables) -> DataFrame:
    areas = F.create_map(*(x for k, v in _SEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<int>"))))
    wide = t.nation.select(F.col("n_nationkey").alias("region"), F.explode(F.element_at(areas, F.col("n_regionkey"))).alias("area"))
    return wide.join(t.part.select("p_size").distinct(), F.col("area") == F.col("p_size"), "left_semi")


@query("""
SELECT c_custkey, c_name IS NOT NULL AS named, 'D' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code,
  round(c_acctbal / 100, 4) AS lat, 'https://sites.example.org/D' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '/' || lower(c_mktsegment) AS url,
  regexp_replace(c_name, '#[0-9]+$', '') AS name FROM customer
""")
def mapped_sites(t: Tables) -> DataFrame:
    code = F.format_string("D%02d", F.col("c_nationkey"))
    return t.customer.select("c_custkey", F.col("c_name").isNotNull().alias("named"), code.alias("code"), F.round(F.col("c_acctbal") / 100, 4).alias("lat"),
                             F.concat(F.lit("https://sites.example.org/"), code, F.lit("/"), F.lower("c_mktsegment")).alias("url"), F.regexp_replace("c_name", "#[0-9]+$", "").alias("name"))


@query(f"""
WITH p AS (SELECT c_custkey, {_PLACE.format(k='c_custkey')} FROM customer),
s AS (SELECT n_nationkey AS state, n_nationkey * 12 - 160 AS x, n_nationkey % 9 * 12 - 55 AS y FROM nation),
i AS (SELECT c_custkey, min(state) AS state FROM p JOIN s ON lng > x AND lng < x + 8 AND lat > y AND lat < y + 8 - (lng - x) GROUP BY c_custkey),
n AS (SELECT c_custkey, state FROM p CROSS JOIN s WHERE c_custkey NOT IN (SELECT c_custkey FROM i)
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {_KM.format(a='p.lat', b='p.lng', c='(s.y + 3.0)', d='(s.x + 3.0)')}, state) = 1)
SELECT c_custkey, state, 'polygon' AS how FROM i UNION ALL SELECT c_custkey, state, 'nearest' FROM n
""")
def point_states(t: Tables) -> DataFrame:
    points = t.customer.selectExpr("c_custkey", *_PLACE.format(k="c_custkey").replace("e0", "D").split(", "))
    corner = t.nation.selectExpr("n_nationkey AS state", "CAST(n_nationkey * 12 - 160 AS DOUBLE) AS x", "CAST(n_nationkey % 9 * 12 - 55 AS DOUBLE) AS y")
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    inside = polygon_join(points, corner.select("state", F.array(F.array(at(0, 0), at(8, 0), at(0, 8))).alias("rings")), "lng", "lat", cell=5.0)
    inside = inside.groupBy("c_custkey").agg(F.min("state").alias("state"))
    centres = corner.selectExpr("state AS target", "y + 3 AS lat", "x + 3 AS lng")
    rest = nearest(points.join(inside, "c_custkey", "left_anti"), centres, "c_custkey").select("c_custkey", F.col("target").alias("state"))
    return inside.withColumn("how", F.lit("polygon")).unionAll(rest.withColumn("how", F.lit("nearest")))


@query()
def farthest_vectors(t: Tables) -> DataFrame:
    """Eight vectors spread as far as possible in their first two components, from the smallest id on."""
    points = t.embeddings.select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return farthest_points(points, "vec_id", "x", "y", 8)


# Parsers.


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN [] WHEN c_custkey % 7 = 1 THEN [(c_custkey % 90) + 0.5, -((c_custkey % 180) + 0.25)] WHEN c_custkey % 7 = 2 THEN [(c_custkey % 90) + 0.5] ELSE CASE c_custkey % 3 WHEN 0 THEN [(c_custkey % 90) + 0.25] WHEN 1 THEN [-((c_custkey % 90) + 30 / 60.0)] ELSE [(c_custkey % 90)::DOUBLE, -((c_custkey % 180) + 15 / 60.0 + 36 / 3600.0)] END END::DOUBLE[] AS places FROM customer")
def parsed_places(t: Tables) -> DataFrame:
    said = F.expr("""CASE WHEN c_custkey % 7 = 0 THEN concat('No Exit, 3 4 5 6', c_custkey, 'N and 12 99 E')
        WHEN c_custkey % 7 = 1 THEN concat('N ', c_custkey % 90, '° 30\\' W ', c_custkey % 180, '° 15\\'') WHEN c_custkey % 7 = 2 THEN concat('lat ', c_custkey % 90, ',5°N')
        ELSE CASE c_custkey % 3 WHEN 0 THEN concat('at ', c_custkey % 90, '.25°N') WHEN 1 THEN concat(c_custkey % 90, '°30\\'S') ELSE concat(c_custkey % 90, '°N ', c_custkey % 180, '°15\\'36\\"W') END END""")
    return t.customer.withColumn("said", said).select("c_custkey", angles("said").alias("places"))


PLANS.oracles["parsed_places"] = "SELECT c_custkey, k, round(places[k], 9) AS place FROM (SELECT *, unnest(range(1, len(places) + 1)) AS k FROM (" + PLANS.oracles["parsed_places"] + "))"
_places = PLANS.queries["parsed_places"]
PLANS.queries["parsed_places"] = lambda spark, sf_dir: _places(spark, sf_dir).select("c_custkey", F.posexplode("places").alias("k", "place")).select("c_custkey", (F.col("k") + 1).cast("long").alias("k"), F.round("place", 9).alias("place"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, round(o_totalprice, 2) AS amount FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, 2001, 7.0 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 > 0")
def parsed_amounts(t: Tables) -> DataFrame:
    amount = "replace(format_number(o_totalprice, 2), ' ', '')"
    loose = "element_at(array('FY 2018 $5', 'the FY report', 'FY 2019=$1.2.3', 'FY =', 'FY 20x1 = $4', '', 'FYFY = = 3'), int(1 + o_custkey % 7))"
    said = F.expr(f"if(o_orderkey % 5 = 0, {loose}, concat('FY ', year(o_orderdate), if(o_orderkey % 3 = 0, ' = ', ' = $'), {amount}, if(o_orderkey % 2 = 0, '; FY2001 = $7', ' total')))")
    return t.orders.withColumn("said", said).select("o_orderkey", F.inline(yearly_amounts("said")))
