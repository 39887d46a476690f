"""Name similarity and fuzzy joins that lose no pair.

A pair's token-set score compares the shared tokens with each side, and both sides with each other. So a pair of
``threshold`` or more either has a side most of whose length is shared tokens, or two sides whose characters differ little.
The first kind meets on a token: of a side's tokens, rare ones first, unshared ones weigh too little to
fill the first few. The second kind meets on one of the first grams of both sides, again rare ones first.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fathomline.operators.graph import checkpoints, kept


#: Rows of one mark that a task joins at most, from either side.
SPLIT = 4096

#: Pairs that a task scores.
SCORED = 50_000


def indel_ratio(a: str, b: str) -> float:
    """100 x 2 LCS / (len a + len b), with one number's bits as a row of the LCS table."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set(a: str | None, b: str | None) -> float:
    """The best indel ratio among the shared tokens alone and with either side's other tokens.

    Shared tokens that make up one whole side score 100; an empty side scores 0.
    """
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    tried = [indel_ratio(one, two)]
    if both:
        tried += [indel_ratio(base, one), indel_ratio(base, two)]
    return max(tried)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def tokens(name: str | Column, least: int = 1) -> Column:
    """Distinct lower-cased tokens of at least ``least`` characters."""
    c = F.col(name) if isinstance(name, str) else name
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least))


def named(column: str | Column) -> Column:
    """Lower case with single spaces, so that SQL and Python see the same tokens."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(F.lower(c), "[\\s\\x1c-\\x1f\\x85\\p{Z}]+", " "))


def _ranked(marks: DataFrame, heavy: Column) -> DataFrame:
    """(side, id, mark, at, before, n): the marks of each name, rare ones first, with the weight of those before them."""
    rare = marks.groupBy("mark").agg(F.count("*").alias("n"))
    order = Window.partitionBy("side", "id").orderBy("n", "mark")
    return marks.join(rare, "mark").withColumn("weight", heavy).withColumn("at", F.row_number().over(order)).withColumn(
        "before", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))


def _met(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(l, r) of rows (id, mark, size, n) that share a mark and whose lengths allow a score of ``t``; size null: any length.

    A mark that many rows hold is dealt to several tasks: rows of one side by their id, those of the other to each part.
    """
    parts = F.expr(f"int(1 + n DIV {SPLIT})")
    a = left.select(F.col("id").alias("l"), "mark", F.col("size").alias("__x"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    b = right.select(F.col("id").alias("r"), "mark", F.col("size").alias("__y"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    near = F.expr(f"__x IS NULL OR __y IS NULL OR abs(__x - __y) <= {1 - t + 1e-9!r}D * (__x + __y)")
    return a.join(b, ["mark", "part"]).where(near).select("l", "r")


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r): ids of the rows (id, name) that may score ``threshold`` or more, each pair once; no other pair does."""
    t = threshold / 100
    if not 2 / 3 <= t <= 1:
        raise ValueError("a threshold from 67 to 100 is needed to find all pairs by what they share")
    both = left.select("id", "name", F.lit("l").alias("side")).unionByName(right.select("id", "name", F.lit("r").alias("side")))
    both = both.withColumn("size", F.length("name"))
    words = both.select("side", "id", "size", F.explode(F.array_distinct(F.split("name", " "))).alias("mark"))
    # the score joins distinct tokens, so the length that counts is theirs
    sizes = words.groupBy("side", "id").agg((F.sum(F.length("mark") + 1) - 1).alias("joined"))
    checkpoints(left.sparkSession)
    tokens_ = _ranked(words.select("side", "id", "mark"), F.length("mark") + 1).join(sizes, ["side", "id"]).checkpoint()
    few = F.expr(f"before <= {2 * (1 - t) / (2 - t) + 1e-9!r}D * joined")
    of = lambda rows, side: rows.where(F.col("side") == side)
    any_size = tokens_.withColumn("size", F.lit(None).cast("int"))
    by_token = _met(of(any_size.where(few), "l"), of(any_size, "r"), t).unionAll(_met(of(any_size, "l"), of(any_size.where(few), "r"), t))
    # two characters each, with a space before and behind every token; a repeated one is told apart by its number
    padded = words.withColumn("w", F.concat(F.lit(" "), "mark", F.lit(" ")))
    two = padded.select("side", "id", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("two"))
    counted = two.groupBy("side", "id", "two").agg(F.count("*").alias("c"))
    grams = counted.select("side", "id", F.explode(F.expr("transform(sequence(1, int(c)), i -> concat(two, '|', i))")).alias("mark"))
    ranked = _ranked(grams, F.lit(1)).join(sizes, ["side", "id"]).withColumn("size", F.col("joined"))
    first = ranked.where(f"at <= floor({4 * (1 - t) / (2 - t) + 1e-9!r}D * joined) + 1").checkpoint()
    return by_token.unionAll(_met(of(first, "l"), of(first, "r"), t)).distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, threshold: float, residual: Column | None = None) -> DataFrame:
    """All pairs that score at least ``threshold`` (67 or more) by token sets and pass the residual condition, with ``score``.

    Null and blank names score nothing. Names are compared once however many rows have them, so repeated rows
    cost only their output. An empty side gives no rows.
    """
    keyed = lambda df, name: df.withColumn("__n", named(name)).where("__n <> ''")
    a, b = keyed(left, left_name).withColumnRenamed("__n", "__l"), keyed(right, right_name).withColumnRenamed("__n", "__r")
    names = lambda df, c: df.select(F.col(c).alias("name")).distinct().withColumn("id", F.col("name"))
    pairs = candidates(names(a, "__l"), names(b, "__r"), threshold)
    # written down to be counted, since each pair costs Python far more than its few bytes suggest
    pairs = kept(pairs.select(F.col("l").alias("__a"), F.col("r").alias("__b")))
    n = pairs.count()
    pairs = pairs.repartition(max(1, -(-n // SCORED))) if n > SCORED else pairs
    scored = pairs.withColumn("score", token_set_ratio("__a", "__b")).where(F.col("score") >= threshold)
    joined = scored.join(a, F.col("__a") == F.col("__l")).join(b, F.col("__b") == F.col("__r"))
    if residual is not None:
        joined = joined.where(residual)
    return joined.select(*left.columns, *right.columns, "score")


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the smaller side; 0 if one is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))
