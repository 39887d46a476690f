"""Which institution record, if any, a facility is: candidates scored by shared words, then six gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import GENERIC_SITE_WORDS, GENERIC_WORDS, distinctive, organisation

#: Words that name what a site is.
ROLE_WORDS = (
    "station", "site", "reserve", "refuge", "sanctuary", "monument", "seashore", "preserve", "forest", "farm", "park", "observatory",
    "laboratory", "lab", "institute", "center", "centre", "hub",
)
#: Words that name a legal form.
FORM_WORDS = (
    "foundation", "institute", "association", "society", "coalition", "alliance", "trust", "fund", "friends", "stewards", "conservancy",
    "partnership", "commission", "council", "corporation", "company", "university", "college", "aquarium", "museum", "hospital",
)
_GENERIC = GENERIC_WORDS + GENERIC_SITE_WORDS


def _among(words: Column, fixed: tuple[str, ...]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, fixed)))


def _raw(text: str) -> Column:
    """All lower-case words of a name, with nothing left out."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1))


def judged_institutions(facilities: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """(facility, institution, matched, decision), one row a facility.

    ``facilities`` are (facility, name, acronym, country), ``candidates`` (facility, place, id, status, country, names), names being structs of value and
    types with ``display`` and ``acronym`` among them; the first ``most`` by place are looked at, as the search gave them. Records that aren't active or lie in
    another country don't count. A candidate scores by distinctive words in common or by the acronym. The best one must share the facility's
    leading word (``review-head-token-missing``); share all words, two, or one with the acronym (``review-acronym-only``, ``review-weak-n-token``); name no other
    distinctive word (``review-extra-token-``); name a role where the facility does (``review-parent-org``); be of no other legal form
    (``review-org-form-``); and have no equal (``ambiguous``). Then the decision is ``acronym-match`` or ``name-token-match``. Others are ``no-match``, or
    ``name-too-generic`` where a name has no distinctive word and there is no acronym. Null names and statuses count as empty and active.
    """
    own = facilities.select("facility", F.coalesce("name", F.lit("")).alias("name"), F.upper(F.coalesce("acronym", F.lit(""))).alias("acr"), F.upper("country").alias("land"))
    own = own.withColumn("compared", organisation("name")).withColumn("want", distinctive(F.col("compared"), _GENERIC))
    first = Window.partitionBy("facility").orderBy("place", "id")
    asked = candidates.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= most)
    code = F.substring_index(F.regexp_replace(F.coalesce("id", F.lit("")), "/+$", ""), "/", -1)
    asked = asked.select("facility", "turn", code.alias("code"), F.coalesce("status", F.lit("active")).alias("status"), F.upper("country").alias("there"), "names")
    open_ = own.join(asked, "facility").where((F.col("status") == "active") & (F.col("code") != "") & F.coalesce(F.col("land") == F.col("there"), F.lit(True)))
    name = open_.select("facility", "turn", F.explode("names").alias("n")).select("facility", "turn", F.trim("n.value").alias("value"), F.coalesce("n.types", F.array()).alias("types")).where("value <> ''")
    capital = (F.upper("value") == F.col("value")) & (F.lower("value") != F.col("value"))
    words = F.when((F.length("value") >= 4) & ~capital, distinctive(organisation("value"), _GENERIC)).otherwise(F.array())
    named = name.withColumn("words", words).groupBy("facility", "turn").agg(
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
        F.coalesce(F.min(F.when(F.array_contains("types", "display"), F.col("value"))), F.min("value")).alias("display"),
        F.collect_set(F.when(F.array_contains("types", "acronym"), F.upper("value"))).alias("acronyms"))
    met = open_.drop("names").join(named, ["facility", "turn"]).withColumn("shared", F.array_intersect("want", "words"))
    by_acronym = (F.col("acr") != "") & F.array_contains("acronyms", F.col("acr"))
    scored = met.withColumn("acronym_hit", by_acronym).where(by_acronym | (F.size("shared") > 0)).withColumn(
        "strength", F.struct((F.size("shared") == F.size("want")).alias("all"), F.size("shared").alias("n"), F.col("acronym_hit")))
    best = scored.groupBy("facility").agg(F.max("strength").alias("top"))
    tied = scored.join(best, "facility").where("strength = top")
    one = tied.groupBy("facility").agg(
        F.min_by(F.struct("code", "display", "shared", "want", "compared", "name", "acronym_hit"), "turn").alias("c"),
        F.array_sort(F.collect_list(F.struct("turn", "display"))).alias("rivals"))
    c = one.select("facility", "c.*", "rivals").withColumn("plain", organisation("display"))
    n, head = F.size("shared"), F.get("want", 0)
    extra = F.array_sort(F.array_except(distinctive(F.col("plain"), _GENERIC), "want"))
    roles = lambda x: F.size(_among(F.split(x, " "), ROLE_WORDS)) > 0
    form = F.array_sort(F.array_except(_among(_raw("display"), FORM_WORDS), _raw("name")))
    enough = (n == F.size("want")) | (n >= 2) | (F.col("acronym_hit") & (n >= 1))
    decision = (
        F.when(head.isNotNull() & ~F.array_contains("shared", head), "review-head-token-missing")
        .when(~enough, F.concat(F.lit("review-"), F.when(F.col("acronym_hit"), "acronym-only").otherwise(F.concat(F.lit("weak-"), n.cast("string"), F.lit("-token")))))
        .when(F.size(extra) > 0, F.concat(F.lit("review-extra-token-"), F.array_join(F.slice(extra, 1, 2), "-")))
        .when(roles(F.col("compared")) & ~roles(F.col("plain")), "review-parent-org")
        .when(F.size(form) > 0, F.concat(F.lit("review-org-form-"), F.array_join(form, "-")))
        .when(F.size("rivals") > 1, "ambiguous").when(F.col("acronym_hit"), "acronym-match").otherwise("name-token-match"))
    told = c.withColumn("decision", decision).select(
        "facility", F.when(F.col("decision").isin("acronym-match", "name-token-match"), F.col("code")).alias("institution"),
        F.when(F.col("decision") == "ambiguous", F.array_join(F.transform("rivals", lambda x: x["display"]), "; ")).otherwise(F.col("display")).alias("matched"), "decision")
    vague = (F.size("want") == 0) & (F.col("acr") == "")
    rest = own.join(told, "facility", "left")
    return rest.select(
        "facility", F.when(~vague, F.col("institution")).alias("institution"), F.when(~vague, F.col("matched")).alias("matched"),
        F.when(vague, "name-too-generic").otherwise(F.coalesce("decision", F.lit("no-match"))).alias("decision"))
