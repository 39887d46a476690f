"""Bibliometric and funding measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.graph import checkpoints
from fathomline.operators.keys import _cols, either_end, top_per_group


def h_index(citations: str | Column) -> Column:
    """Aggregate: the largest k such that k values are at least k; nulls count as zero.

    The list holds values over zero only, which are those that can raise the index.
    """
    c = F.col(citations) if isinstance(citations, str) else citations
    down = F.sort_array(F.collect_list(F.when(c > 0, c)), asc=False)
    reached = F.transform(down, lambda v, i: F.when(v >= i + 1, i + 1).otherwise(0))
    return F.coalesce(F.array_max(reached), F.lit(0))


def h_index_of_groups(df: DataFrame, group: str | Sequence[str], citations: str) -> DataFrame:
    """(group, h_index) for groups of any size: values are counted first, and only a value's
    count enters the list, so a group's list is as long as it has different values."""
    keys = _cols(group)
    counted = df.groupBy(*keys, F.coalesce(F.col(citations), F.lit(0)).alias("v")).agg(F.count("*").alias("n"))
    down = F.sort_array(F.collect_list(F.struct("v", "n")), asc=False)
    h = F.aggregate(
        down,
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("h")),
        lambda a, x: F.struct(
            (a["seen"] + x["n"]).alias("seen"),
            F.greatest(a["h"], F.least(x["v"].cast("long"), a["seen"] + x["n"])).alias("h"),
        ),
        lambda a: a["h"],
    )
    return counted.groupBy(*keys).agg(h.alias("h_index"))


def z_composite(df: DataFrame, group: str | Sequence[str], columns: Sequence[str], name: str = "composite_z") -> DataFrame:
    """Sum of within-group z-scores; a group without spread adds zero.

    Mean and deviation come from an aggregate that is joined back, so a large group is not one
    window partition.
    """
    keys = _cols(group)
    stats = df.groupBy(*keys).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_samp))))
    parts = [F.coalesce((F.col(c) - F.col(f"__mu_{c}")) / F.nullif(F.col(f"__sd_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.join(stats, keys).withColumn(name, total).select(*df.columns, name)


def global_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """For each column, under its name: the rows before each row's value in ascending order (nulls first), without a one-task sort.

    Columns of one type go together: their values are counted, dealt to as many ranges as the session has shuffle partitions, counted up within a
    range and shifted by the ranges before. Equal values share a range, so the result is exact. The counted values are written down once, since
    ranges that are drawn anew may differ.
    """
    checkpoints(df.sparkSession)
    kinds: dict[str, list[str]] = {}
    for c in names:
        kinds.setdefault(dict(df.dtypes)[c], []).append(c)
    out = df
    for columns in kinds.values():
        each = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))
        counts = df.select(F.explode(each).alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
        placed = counts.repartitionByRange("c", F.col("v").asc_nulls_first()).withColumn("piece", F.spark_partition_id()).checkpoint()
        before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        bases = placed.groupBy("c", "piece").agg(F.sum("n").alias("size")).select("c", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("c", "piece").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        at = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
        ranked = placed.join(bases, ["c", "piece"]).select("c", "v", at.alias("r")).checkpoint()
        for c in columns:
            one = ranked.where(F.col("c") == c).select(F.col("v").alias("__v"), F.col("r").alias(names[c]))
            out = out.join(one, F.col(c).eqNullSafe(F.col("__v"))).drop("__v")
    return out


def percent_rank_score(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Weighted sum of global percent ranks."""
    n = df.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("__of"))
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.lit(w) * F.col(f"__r_{c}") / F.col("__of")
    out = global_ranks(df, {c: f"__r_{c}" for c in weights})
    return out.crossJoin(F.broadcast(n)).withColumn(name, score).select(*df.columns, name)


def tier_cut(df: DataFrame, score: str, pinned: str, core_size: int, key: str, name: str = "tier") -> DataFrame:
    """"core" for pinned rows and the best others up to max(core_size, pinned rows), else "archive".

    The cut is found as the k-th row of a top-k, not by numbering all rows.
    """
    n_pinned = df.where(pinned).count()
    best = df.where(~F.coalesce(F.col(pinned), F.lit(False))).orderBy(F.desc_nulls_last(score), key).limit(max(0, max(core_size, n_pinned) - n_pinned)).select(key)
    core = df.where(pinned).select(key).unionByName(best).withColumn(name, F.lit("core"))
    return df.join(core, key, "left").withColumn(name, F.coalesce(name, F.lit("archive")))


#: Rows that a task gets where it holds what it makes of them.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows dealt by keys to as many tasks as their number asks for, no fewer than the session's shuffle partitions; ``rows`` gives the number where it is known."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, 1 + (df.count() if rows is None else rows) // TASK_ROWS), *keys)


def co_occurrence(df: DataFrame, item: str, member: str, year: str, least: int = 1, cap: float = 20.0) -> DataFrame:
    """(a, b, n, first_year, last_year, strength) for members a < b that share items.

    Member rows of an item are made distinct first, so pairs are per item and not per row. Items are dealt to a number of tasks that
    grows with the rows, since a task counts its pairs before they shuffle. Where the members could make more different pairs than
    the session's shuffle partitions should hold, pairs are dealt to a number of tasks that grows with them: about the rows times
    half an item's mean, or 64 times the rows at most. That number decides the tasks and never the result.
    """
    given = df.select(item, member, year).where(f"{member} IS NOT NULL AND {item} IS NOT NULL")
    n, items, members = given.agg(F.count("*"), F.approx_count_distinct(item), F.approx_count_distinct(member)).first()
    rows = dealt(given, item, rows=n).groupBy(item, member).agg(F.max(year).alias("y"))
    a, b = rows.alias("x"), rows.alias("z")
    pairs = a.join(b, (F.col(f"x.{item}") == F.col(f"z.{item}")) & (F.col(f"x.{member}") < F.col(f"z.{member}"))).select(
        F.col(f"x.{member}").alias("a"), F.col(f"z.{member}").alias("b"), "x.y")
    most = members * members // 2
    if most > TASK_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        pairs = dealt(pairs, "a", "b", rows=min(most, n * n // (2 * items), 64 * n))
    return pairs.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year")
    ).where(F.col("n") >= least).withColumn("strength", F.least(F.col("n") / F.lit(cap), F.lit(1.0)))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    return either_end(edges.select("a", "b")).groupBy("node").agg(F.count("*").alias("degree"))


def area_weights(scores: DataFrame, person: str, work: str, area: str, score: str, least_weight: float = 0.0, least_evidence: int = 1, top: int | None = None) -> DataFrame:
    """(person, area, weight, evidence): area scores summed over works, by the person's works with topics."""
    works = scores.groupBy(person).agg(F.countDistinct(work).alias("__works"))
    out = scores.groupBy(person, area).agg(F.sum(score).alias("__sum"), F.countDistinct(work).alias("evidence")).join(works, person)
    out = out.select(person, area, F.round(F.col("__sum") / F.greatest("__works", F.lit(1)), 4).alias("weight"), "evidence")
    out = out.where((F.col("weight") >= least_weight) & (F.col("evidence") >= least_evidence))
    return top_per_group(out, person, [F.desc("weight"), F.desc("evidence"), F.col(area)], top) if top else out


def coverage(df: DataFrame, area: str, facets: Sequence[str], member: str) -> DataFrame:
    """(area, facet, value, n): distinct members by area and each facet, one expansion per row."""
    long = df.select(area, member, F.explode(F.array(*(
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets
    ))).alias("x"))
    return long.groupBy(area, "x.facet", "x.value").agg(F.countDistinct(member).alias("n"))


def shares(df: DataFrame, group: str, total: str, name: str = "share") -> DataFrame:
    """Group sums and their share of the whole."""
    sums = df.groupBy(group).agg(F.sum(total).alias(total))
    whole = sums.agg(F.sum(total).alias("__all"))
    return sums.crossJoin(F.broadcast(whole)).select(group, total, (F.col(total) / F.col("__all")).alias(name))


def arg_max(value: str, by: str) -> Column:
    """Aggregate: the non-null value with the greatest key; rows without a value don't count."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(by)))


def confidence_score(score: str, confidence: str) -> Column:
    """A topic score (0.5 where unknown) by the crosswalk's confidence: high 1, medium 0.7, else 0.4."""
    return F.coalesce(F.col(score), F.lit(0.5)) * F.when(F.col(confidence) == "high", 1.0).when(F.col(confidence) == "medium", 0.7).otherwise(0.4)
