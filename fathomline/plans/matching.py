"""Staged matching over the given tables, with SQL that compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import matching
from fathomline.operators.fuzzy import fuzzy_join
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query


def _lcs(x: str, y: str) -> str:
    """SQL for the length of the longest common subsequence, row by row; a row is the running maximum of its steps."""
    rows = f"list_transform(string_split({x}, ''), lambda c: list_transform(string_split({y}, ''), lambda d: (c = d)::INTEGER))"
    step = "greatest(r[k], (CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END) + e[k])"
    return (
        f"list_reduce(list_prepend(list_transform(range(length({y})), lambda z: 0::INTEGER), {rows}), "
        f"lambda r, e: list_transform(range(1, len(e) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: {step}))))[-1]")


def _scored(pairs: str, a: str, b: str) -> str:
    """SQL steps from a table of pairs with names a and b, in lower case, to ``scored`` with the token-set score."""
    ratio = lambda x, y: f"200.0 * {_lcs(x, y)} / (length({x}) + length({y}))"
    return f"""
worded AS (SELECT *, list_distinct(list_filter(string_split({a}, ' '), lambda t: t <> '')) AS ta, list_distinct(list_filter(string_split({b}, ' '), lambda t: t <> '')) AS tb FROM {pairs}),
halves AS (SELECT *, list_sort(list_intersect(ta, tb)) AS s, list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS u, list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS v
  FROM worded WHERE len(ta) > 0 AND len(tb) > 0),
joined AS (SELECT *, array_to_string(s, ' ') AS s0, array_to_string(list_concat(s, u), ' ') AS s1, array_to_string(list_concat(s, v), ' ') AS s2 FROM halves),
scored AS (SELECT *, CASE WHEN len(s) > 0 AND (len(u) = 0 OR len(v) = 0) THEN 100.0
  WHEN len(s) = 0 THEN {ratio('s1', 's2')} ELSE greatest({ratio('s1', 's2')}, {ratio('s0', 's1')}, {ratio('s0', 's2')}) END AS score FROM joined)"""


@query(f"""
WITH pairs AS (SELECT a.p_name AS left_name, b.p_name || ' mk2' AS right_name FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b),
{_scored('pairs', 'left_name', 'right_name')}
SELECT left_name, right_name, round(score, 6) AS score FROM scored WHERE score >= 70
""")
def fuzzy_names(t: Tables) -> DataFrame:
    """All part names that agree as token sets."""
    a = t.part.select(F.col("p_name").alias("left_name")).distinct()
    b = t.part.select(F.concat(F.col("p_name"), F.lit(" mk2")).alias("right_name")).distinct()
    return fuzzy_join(a, b, "left_name", "right_name", 70.0).select("left_name", "right_name", F.round("score", 6).alias("score"))


_PLACED = """SELECT c_custkey AS k, c_nationkey || '-' || c_mktsegment || '-' || CAST(floor(c_acctbal / 400) AS INTEGER) AS id,
  'x' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) % 1499 AS VARCHAR) AS url, c_nationkey AS nation, c_acctbal AS bal FROM customer"""


@query(f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM ({_PLACED})),
e AS (SELECT a.i AS a, b.i AS b, CASE WHEN a.id = b.id THEN 0 WHEN a.url = b.url THEN 1 ELSE 2 END AS rule FROM c a JOIN c b
  ON a.i < b.i AND (a.id = b.id OR a.url = b.url OR (a.nation = b.nation AND abs(a.bal - b.bal) < 40))),
n AS (SELECT b, list(a) AS before FROM e GROUP BY b),
walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.i + 1, CASE WHEN len(list_intersect(w.kept, coalesce(n.before, []))) = 0 THEN list_append(w.kept, w.i + 1) ELSE w.kept END
  FROM walk w LEFT JOIN n ON n.b = w.i + 1 WHERE w.i < (SELECT count(*) FROM c)),
stays AS (SELECT unnest(kept) AS i FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
goes AS (SELECT e.b AS i, min((e.rule, e.a)) AS m, min(e.rule) AS rule FROM e JOIN stays ON stays.i = e.a WHERE e.b NOT IN (SELECT i FROM stays) GROUP BY e.b),
into_ AS (SELECT g.i, g.rule, min(e.a) AS a FROM goes g JOIN e ON e.b = g.i AND e.rule = g.rule JOIN stays ON stays.i = e.a GROUP BY g.i, g.rule)
SELECT c.k, coalesce(t.k, c.k) AS record, CASE into_.rule WHEN 0 THEN 'id' WHEN 1 THEN 'url' WHEN 2 THEN 'pair' END AS rule
FROM c LEFT JOIN into_ ON into_.i = c.i LEFT JOIN c t ON t.i = into_.a
""")
def greedy_customers(t: Tables) -> DataFrame:
    """Customers in the order of their keys, each kept unless an earlier kept one has its id or url or a near balance in its nation."""
    c = t.customer.selectExpr(
        "c_custkey AS k", "concat(c_nationkey, '-', c_mktsegment, '-', CAST(floor(c_acctbal / 400) AS INT)) AS id",
        "concat('x', CAST(round(c_acctbal * 100) AS BIGINT) % 1499) AS url", "c_nationkey AS nation", "c_acctbal AS bal")
    return matching.greedy_records(c, "k", "k", [("id", F.col("id")), ("url", F.col("url"))], near=("pair", F.col("nation"), F.col("bal"), 40.0))


_ASKED = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN upper('Supplier#' || lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0')) WHEN 2 THEN lpad(CAST(o_custkey % 120 AS VARCHAR), 8, '0')
  WHEN 3 THEN 'Suplier#' || lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0') WHEN 4 THEN 'Nothing Known ' || (o_custkey % 9) WHEN 5 THEN '' WHEN 6 THEN '00' || (o_custkey % 12) END AS mention,
  CASE WHEN o_orderkey % 7 IN (0, 3) AND o_custkey % 2 = 0 THEN 's' || (o_custkey % 120) END AS acronym FROM orders"""


@query(f"""
WITH asked AS ({_ASKED}), target AS (SELECT s_suppkey AS target, s_name AS name, 'S' || s_suppkey AS acronym FROM supplier),
m AS (SELECT DISTINCT mention, acronym, lower(coalesce(mention, '')) AS low FROM asked),
one AS (SELECT m.mention, m.acronym, min(t.target) AS target FROM m JOIN target t ON lower(m.acronym) = lower(t.acronym) GROUP BY ALL),
two AS (SELECT m.mention, m.acronym, min(t.target) AS target FROM m JOIN target t ON m.low = lower(t.name) AND m.low <> '' GROUP BY ALL),
three AS (SELECT m.mention, m.acronym, min(t.target) AS target FROM m JOIN target t ON contains(lower(t.name), m.low) AND m.low <> '' GROUP BY ALL HAVING count(*) = 1),
pairs AS (SELECT DISTINCT m.low AS a, lower(t.name) AS b, t.target FROM m, target t WHERE m.low <> ''),
{_scored('pairs', 'a', 'b')},
four AS (SELECT a AS low, arg_min(target, (-score, target)) AS target FROM scored WHERE score >= 85 GROUP BY a)
SELECT o_orderkey, coalesce(one.target, two.target, three.target, four.target) AS target,
  CASE WHEN one.target IS NOT NULL THEN 'acronym' WHEN two.target IS NOT NULL THEN 'name' WHEN three.target IS NOT NULL THEN 'part' WHEN four.target IS NOT NULL THEN 'fuzzy' END AS rule
FROM asked LEFT JOIN one ON one.mention IS NOT DISTINCT FROM asked.mention AND one.acronym IS NOT DISTINCT FROM asked.acronym
LEFT JOIN two ON two.mention IS NOT DISTINCT FROM asked.mention AND two.acronym IS NOT DISTINCT FROM asked.acronym
LEFT JOIN three ON three.mention IS NOT DISTINCT FROM asked.mention AND three.acronym IS NOT DISTINCT FROM asked.acronym
LEFT JOIN four ON four.low = lower(coalesce(asked.mention, ''))
""")
def resolved_facilities(t: Tables) -> DataFrame:
    """Mentions in orders against suppliers by acronym, name, the only name that holds the mention, and the best score."""
    number = "lpad(CAST(o_custkey % 120 AS STRING), 9, '0')"
    asked = t.orders.selectExpr(
        "o_orderkey", f"""CASE o_orderkey % 7 WHEN 1 THEN upper(concat('Supplier#', {number})) WHEN 2 THEN lpad(CAST(o_custkey % 120 AS STRING), 8, '0')
        WHEN 3 THEN concat('Suplier#', {number}) WHEN 4 THEN concat('Nothing Known ', o_custkey % 9) WHEN 5 THEN '' WHEN 6 THEN concat('00', o_custkey % 12) END AS mention""",
        "CASE WHEN o_orderkey % 7 IN (0, 3) AND o_custkey % 2 = 0 THEN concat('s', o_custkey % 120) END AS acronym")
    target = t.supplier.selectExpr("s_suppkey AS target", "s_name AS name", "concat('S', s_suppkey) AS acronym")
    return matching.resolve_facilities(asked, target).select("o_orderkey", "target", "rule")


_ITEMS = """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's' WHEN 2 THEN ' ' || p_name || ' National Park' WHEN 3 THEN p_name || ' annex'
  WHEN 4 THEN p_type || ' works' END AS name FROM part"""


@query(f"""
WITH items AS (SELECT p_partkey, replace(lower(trim(coalesce(name, ''))), 'national park', 'np') AS p FROM ({_ITEMS})),
f AS (SELECT min(p_partkey) AS target, lower(p_name) AS p FROM part WHERE p_type = 'ECONOMY' GROUP BY lower(p_name)),
parks AS (SELECT DISTINCT lower(p_name) || ' np' AS p FROM part WHERE p_type = 'SMALL'), annexes AS (SELECT DISTINCT lower(p_name) || ' annex' AS p FROM part WHERE p_size > 25),
names AS (SELECT DISTINCT p FROM items),
pairs AS (SELECT n.p AS a, f.p AS b, f.target FROM names n, f WHERE n.p NOT IN (SELECT p FROM f) AND n.p NOT IN (SELECT p FROM parks) AND n.p NOT IN (SELECT p FROM annexes)),
{_scored('pairs', 'a', 'b')},
close AS (SELECT a AS p, arg_min(target, (-score, target)) AS target, max(score) AS score FROM scored WHERE score >= 88 GROUP BY a)
SELECT p_partkey, CASE WHEN f.target IS NOT NULL THEN 'match-facility' WHEN i.p IN (SELECT p FROM parks) THEN 'match-legacy-overlay/parks' WHEN i.p IN (SELECT p FROM annexes) THEN 'match-legacy-overlay/annexes'
    WHEN close.target IS NOT NULL THEN 'fuzzy-facility' ELSE 'new' END AS status, coalesce(f.target, close.target) AS target, round(close.score, 6) AS score
FROM items i LEFT JOIN f ON f.p = i.p LEFT JOIN close ON close.p = i.p
""")
def cross_validated_parts(t: Tables) -> DataFrame:
    """Names made from parts against facilities and two overlays, with all four statuses."""
    items = t.part.selectExpr("p_partkey", """CASE p_size % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, 's') WHEN 2 THEN concat(' ', p_name, ' National Park')
        WHEN 3 THEN concat(p_name, ' annex') WHEN 4 THEN concat(p_type, ' works') END AS name""")
    facilities = t.part.where("p_type = 'ECONOMY'").selectExpr("p_partkey AS target", "p_name AS name")
    overlays = [("parks", t.part.where("p_type = 'SMALL'").selectExpr("concat(p_name, ' national park') AS name")), ("annexes", t.part.where("p_size > 25").selectExpr("concat(p_name, ' annex') AS name"))]
    return matching.cross_validated(items, facilities, overlays).select("p_partkey", "status", "target", F.round("score", 6).alias("score"))


@query(r"""
WITH who AS (SELECT c_custkey AS person, 'F' || (c_custkey % 3) AS given, CASE WHEN c_custkey % 11 > 0 THEN 'Fam' || (c_custkey % 40) END AS family,
    CASE WHEN c_custkey % 5 = 0 THEN [] ELSE [c_mktsegment || ' reef' || (c_custkey % 7), 'tide' || (c_custkey % 4)] END AS facilities FROM customer),
cand AS (SELECT o_custkey AS person, 'P' || (o_orderkey % 5000) AS profile, CASE WHEN o_orderkey % 6 = 0 THEN 'F' || (o_custkey % 3) || '.x' ELSE 'F' || (o_custkey % 3) END AS g,
    CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE 'FAM' || (o_custkey % 40) END AS f, o_orderkey AS place,
    [CASE WHEN o_orderkey % 3 = 0 THEN 'University of ' || split_part(o_orderpriority, '-', 2) ELSE 'the machinery reef' || (o_orderkey % 7) END, 'tide' || (o_orderkey % 9) || ' station of ' || o_orderstatus] AS orgs FROM orders),
named AS (SELECT who.person, facilities, profile, orgs, place FROM who JOIN cand USING (person) WHERE family IS NOT NULL AND lower(f) = lower(family) AND starts_with(lower(split_part(g, '.', 1)), lower(given))),
pair AS (SELECT person, profile, place, i, orgs[i] AS org, j, facilities[j] AS facility FROM named, unnest(range(1, len(orgs) + 1)) AS a(i), unnest(range(1, len(facilities) + 1)) AS b(j)),
tok AS (SELECT *, list_distinct(list_filter(string_split(lower(org), ' '), lambda t: length(t) >= 3 AND t NOT IN ('the', 'university', 'not'))) AS a,
    list_distinct(list_filter(string_split(lower(facility), ' '), lambda t: length(t) >= 3)) AS b FROM pair),
scored AS (SELECT *, len(list_intersect(a, b)) / least(len(a), len(b)) AS score FROM tok WHERE len(list_intersect(a, b)) > 0),
best_of AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY person, profile ORDER BY score DESC, place, i, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, place, profile) AS rank FROM best_of WHERE score >= 0.45),
best AS (SELECT * FROM ranked WHERE rank = 1),
only_ AS (SELECT person, count(DISTINCT profile) AS profiles, min(profile) AS profile FROM named WHERE len(facilities) = 0 GROUP BY person),
n AS (SELECT person, count(*) AS n FROM cand GROUP BY person)
SELECT who.person, CASE WHEN family IS NULL THEN NULL WHEN best.profile IS NOT NULL THEN best.profile WHEN profiles = 1 THEN only_.profile END AS profile,
  CASE WHEN family IS NULL THEN 'skip-no-family' WHEN n IS NULL THEN 'no-candidates' WHEN best.profile IS NOT NULL THEN 'accept' WHEN profiles = 1 THEN 'accept-name-only'
    WHEN profiles > 1 THEN 'ambiguous-name-only' ELSE 'no-employment-match' END AS decision,
  CASE WHEN family IS NULL THEN 0 ELSE coalesce(n, 0) END AS candidates, best.org, best.facility
FROM who LEFT JOIN n USING (person) LEFT JOIN best USING (person) LEFT JOIN only_ USING (person)
""")
def resolved_profiles(t: Tables) -> DataFrame:
    """Customers against profiles made from orders, by names and employers, tokens only."""
    people = t.customer.selectExpr(
        "c_custkey AS person", "if(c_custkey % 11 > 0, concat('F', c_custkey % 3, ' Fam', c_custkey % 40), concat('F', c_custkey % 3)) AS name",
        "if(c_custkey % 5 = 0, array(), array(concat(c_mktsegment, ' reef', c_custkey % 7), concat('tide', c_custkey % 4))) AS facilities")
    candidates = t.orders.selectExpr(
        "o_custkey AS person", "concat('P', o_orderkey % 5000) AS profile", "concat('F', o_custkey % 3, if(o_orderkey % 6 = 0, '.x', '')) AS given",
        "if(o_orderkey % 4 = 0, 'other', concat('FAM', o_custkey % 40)) AS family", "o_orderkey AS place",
        "array(if(o_orderkey % 3 = 0, concat('University of ', element_at(split(o_orderpriority, '-'), 2)), concat('the machinery reef', o_orderkey % 7)), concat('tide', o_orderkey % 9, ' station of ', o_orderstatus)) AS orgs")
    found = matching.resolve_profiles(people, candidates, chars=0.0)
    return found.select("person", "profile", "decision", "candidates", "org", "facility")
