"""Data-quality rules: each names a table of violations; an empty one passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    violations: Callable[[], DataFrame]


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def not_in(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    p = parent.select(F.col(key).alias("__p")).distinct()
    return df.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("__p"), "left_anti")


def several(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys with more than one flagged row."""
    return df.where(flag).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def malformed(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))


def drifted(df: DataFrame, key: str, expected) -> DataFrame:
    """Keys that differ from what their fields give."""
    return df.where(~F.col(key).eqNullSafe(expected))


def disordered(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.where(~(F.col(a) < F.col(b)))


def wide_types(df: DataFrame) -> list[str]:
    """Columns whose type a browser can't read as a number."""
    return [c for c, t in df.dtypes if t.startswith("decimal")]


def report(spark, rules: list[Rule]) -> DataFrame:
    """(rule, violations, passed), one job over the union of the counts."""
    out = None
    for r in rules:
        one = r.violations().agg(F.count("*").alias("violations")).select(F.lit(r.name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "rule string, violations long, passed boolean")
    return out.withColumn("passed", F.col("violations") == 0)
