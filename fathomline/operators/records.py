"""Record linkage: duplicate records, confidence-ranked merges, people and registry building, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import bare_url
from fathomline.operators.fuzzy import fuzzy_join
from fathomline.operators.graph import components
from fathomline.operators.nested import joined_set
from fathomline.operators.spatial import haversine_km

#: Rank of a confidence; unknown ones rank lowest.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def confidence_rank(column: str = "confidence") -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def _linked_by(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(a, b): each record with the first of those that share a non-empty value; no pair lists."""
    rows = df.select(F.col(key).alias("b"), value.alias("v")).where("v IS NOT NULL AND v <> ''")
    first = rows.groupBy("v").agg(F.min("b").alias("a"))
    return rows.join(first, "v").where("a <> b").select("a", "b")


def duplicate_records(df: DataFrame, key: str, threshold: float = 92.0, km: float = 5.0) -> DataFrame:
    """(key, record): the smallest key of each class of duplicate records.

    Records (key, id, url, name, lat, lng) are duplicates with one id, one url, or names whose
    token sets score over the threshold at places less than ``km`` apart. Classes are connected
    components, so the order of records doesn't matter.
    """
    far = haversine_km("lat", "lng", "lat2", "lng2") < km
    right = df.select(F.col(key).alias("key2"), F.col("name").alias("name2"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    alike = fuzzy_join(df.select(key, "name", "lat", "lng"), right, "name", "name2", threshold, far & (F.col(key) < F.col("key2")))
    edges = (
        _linked_by(df, key, F.col("id").cast("string")).unionByName(_linked_by(df, key, bare_url("url")))
        .unionByName(alike.select(F.col(key).alias("a"), F.col("key2").alias("b")))
    )
    found = components(edges)
    return df.select(key).join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("record"))


def picked(column: str, seq: str, rank: Column) -> Column:
    """Aggregate: the non-empty value of the highest confidence, the earliest of equals."""
    c = F.col(column)
    filled = c.isNotNull() & (F.trim(c.cast("string")) != "")
    return F.max_by(F.when(filled, c), F.when(filled, F.struct(rank, -F.col(seq))))


def merged_records(df: DataFrame, group: str, scalars: Sequence[str], lists: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """One record per group: scalars picked by confidence, lists united in order of sequence."""
    rank = confidence_rank()
    united = lambda c: F.array_distinct(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce(c, F.array()).alias("l")))), lambda x: x["l"])))
    return df.groupBy(group).agg(*(picked(c, seq, rank).alias(c) for c in scalars), *(united(c).alias(c) for c in lists))


def merged_people(people: DataFrame, key: str, name: str, identifiers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(people without duplicates, (old key, new key)): one person per lower-cased name.

    The fullest row stays, the smaller key of equals. Missing identifiers are taken over; where
    rows disagree, the identifier becomes null and ``conflicts`` names it.
    """
    filled = sum((F.col(c).isNotNull().cast("int") for c in people.columns), F.lit(0))
    keyed = people.withColumn("__n", F.lower(F.trim(name))).withColumn("__filled", filled)
    best = keyed.groupBy("__n").agg(
        F.min(F.struct((-F.col("__filled")).alias("f"), F.col(key).alias("k")))["k"].alias("__to"),
        *(F.min(c).alias(f"__min_{c}") for c in identifiers), *(F.max(c).alias(f"__max_{c}") for c in identifiers),
    )
    joined = keyed.join(best, "__n")
    moved = joined.select(F.col(key).alias("old"), F.col("__to").alias("new"))
    differ = {c: F.col(f"__min_{c}") != F.col(f"__max_{c}") for c in identifiers}
    kept = joined.where(F.col(key) == F.col("__to")).select(
        *(F.when(~F.coalesce(differ[c], F.lit(False)), F.col(f"__min_{c}")).alias(c) if c in identifiers else F.col(c) for c in people.columns),
        F.concat_ws(", ", *(F.when(d, c) for c, d in differ.items())).alias("conflicts"),
    )
    return kept, moved


def repointed(child: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """A child table whose references follow merged keys; rows that become equal are folded."""
    m = moved.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    out = child.join(m, F.col(column) == F.col("__old"), "left")
    return out.select(*(F.coalesce("__new", column).alias(column) if c == column else F.col(c) for c in child.columns)).distinct()


def registry(assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persons, provenance) from assertions (seq, source, name, orcid, openalex_id).

    Assertions are one person if they share an ORCID or an OpenAlex id, through others as well;
    names never join. The key is the least ORCID, else the least OpenAlex id. Rows with neither
    are left out.
    """
    ided = assertions.where("orcid IS NOT NULL OR openalex_id IS NOT NULL")
    edges = _linked_by(ided, "seq", F.col("orcid")).unionByName(_linked_by(ided, "seq", F.col("openalex_id")))
    found = components(edges)
    placed = ided.join(found, F.col("seq") == F.col("node"), "left").withColumn("person", F.coalesce("component", "seq"))
    persons = placed.groupBy("person").agg(
        F.coalesce(F.min("orcid"), F.min("openalex_id")).alias("canonical_id"), F.min_by("name", "seq").alias("display_name"),
        F.min("orcid").alias("orcid"), F.min("openalex_id").alias("openalex_id"), joined_set("source", ",").alias("sources"), F.count("*").alias("assertions"),
    )
    provenance = placed.join(persons.select("person", "canonical_id"), "person").select("canonical_id", "seq", "source")
    return persons.drop("person"), provenance


def verdicts(rows: DataFrame, key: str, checks: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Long form (key, check_id, verdict, evidence) of (name, applies, passes, evidence) checks.

    A check that doesn't apply is not_applicable, one with a null outcome unresolved.
    """
    each = [F.struct(
        F.lit(name).alias("check_id"),
        F.when(~F.coalesce(applies, F.lit(False)), "not_applicable").when(passes.isNull(), "unresolved").when(passes, "pass").otherwise("fail").alias("verdict"),
        evidence.cast("string").alias("evidence"),
    ) for name, applies, passes, evidence in checks]
    return rows.select(key, F.explode(F.array(*each)).alias("c")).select(key, "c.*")


def candidate_scores(df: DataFrame) -> DataFrame:
    """Score 3 x coauthors + works / 2 + 10 for a known institution + 2 for an ORCID, and its class:
    low up to 10, medium up to 40, else high."""
    score = 3 * F.col("coauthors") + 0.5 * F.col("works") + F.when(F.col("has_ror"), 10).otherwise(0) + F.when(F.col("has_orcid"), 2).otherwise(0)
    return df.withColumn("score", score).withColumn("priority", F.when(F.col("score") <= 10, "low").when(F.col("score") <= 40, "medium").otherwise("high"))


def split_identities(left: DataFrame, right: DataFrame, shared: str, other: str) -> DataFrame:
    """Rows with one shared identifier but different others."""
    b = right.select(F.col(shared).alias("__s"), F.col(other).alias("other_id"))
    return left.where(F.col(shared).isNotNull()).join(b, (F.col(shared) == F.col("__s")) & (F.col(other) != F.col("other_id"))).drop("__s")


def url_inventory(sources: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """(url, used_in, n): every non-empty url of (table, column, label), with where it stands."""
    out = None
    for df, column, label in sources:
        one = df.select(F.trim(F.col(column)).alias("url"), F.lit(label).alias("label")).where("url IS NOT NULL AND url <> ''")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("url").agg(joined_set("label", ", ").alias("used_in"), F.count("*").alias("n"))


def shape_violations(nodes: DataFrame, key: str, shapes: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(key, constraint) for each (constraint, target, holds) that a targeted node doesn't hold."""
    broken = F.array_compact(F.array(*(F.when(target & ~F.coalesce(holds, F.lit(False)), name) for name, target, holds in shapes)))
    return nodes.select(key, F.explode(broken).alias("constraint"))


def hidden_overlays(overlays: DataFrame, tags: DataFrame, chosen: Sequence[str], duplicates: Sequence[str]) -> DataFrame:
    """(overlay, hidden): under a narrowing choice, overlays that duplicate a layer or share no chosen tag."""
    kept = tags.where(F.col("tag").isin(*chosen)).select("overlay").distinct().withColumn("__kept", F.lit(True)) if chosen else None
    if kept is None:
        return overlays.select("overlay", F.lit(False).alias("hidden"))
    return overlays.join(kept, "overlay", "left").select("overlay", (F.col("overlay").isin(*duplicates) | F.col("__kept").isNull()).alias("hidden"))


def judged(candidates: DataFrame, key: str, gates: Sequence[tuple[str, Column]], order: Sequence[Column]) -> DataFrame:
    """(key, candidate, decision): the best candidate that passes all gates.

    The decision is ``accepted``, ``ambiguous`` if two pass and are equal in the order, or the
    gate at which the best of those that failed stopped.
    """
    failed = None
    for i, (name, ok) in enumerate(gates):
        stop = F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(i).alias("gate"), F.lit(name).alias("reason")))
        failed = stop if failed is None else F.coalesce(failed, stop)
    marks = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    rows = candidates.withColumn("__f", failed).withColumn("__o", marks)
    good = rows.where("__f IS NULL").groupBy(key).agg(F.min(F.struct("__o", "candidate")).alias("b"), F.collect_list("__o").alias("l"))
    good = good.select(key, F.col("b.candidate").alias("__c"), (F.size(F.filter("l", lambda x: x == F.col("b.__o"))) > 1).alias("__tie"))
    bad = rows.where("__f IS NOT NULL").groupBy(key).agg(F.max("__f")["reason"].alias("__why"))
    joined = candidates.select(key).distinct().join(good, key, "left").join(bad, key, "left")
    return joined.select(
        key, F.when(~F.col("__tie"), F.col("__c")).alias("candidate"),
        F.when(F.col("__c").isNull(), F.col("__why")).when(F.col("__tie"), "ambiguous").otherwise("accepted").alias("decision"))
