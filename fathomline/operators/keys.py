"""Row selection by key: latest rows, top rows, contested keys and identifier resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def top_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group. Spark prunes to n rows per task before it shuffles."""
    w = Window.partitionBy(*_cols(group)).orderBy(*order)
    name = rank or "__rank"
    kept = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def latest(df: DataFrame, key: str | Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order (newest first)."""
    return top_per_group(df, key, order)


def contested(df: DataFrame, claim: str, owner: str) -> DataFrame:
    """Claims made by exactly one owner; a key that two want goes to nobody."""
    one = df.groupBy(claim).agg(F.countDistinct(owner).alias("__owners")).where("__owners = 1")
    return df.join(one.select(claim), claim, "left_semi")


def resolve_by_ids(df: DataFrame, registry: DataFrame, first: tuple[str, str], second: tuple[str, str], key: str, method: tuple[str, str]) -> DataFrame:
    """Registry key by the first identifier, else by the second, with the name of the method.

    Identifier columns are (column of df, column of registry); registry identifiers are unique.
    """
    a = registry.select(F.col(first[1]).alias("__a"), F.col(key).alias("__ka")).where("__a IS NOT NULL")
    b = registry.select(F.col(second[1]).alias("__b"), F.col(key).alias("__kb")).where("__b IS NOT NULL")
    found = df.join(a, df[first[0]] == F.col("__a"), "left").join(b, df[second[0]] == F.col("__b"), "left")
    return found.select(
        *df.columns,
        F.coalesce("__ka", "__kb").alias("resolved"),
        F.when(F.col("__ka").isNotNull(), method[0]).when(F.col("__kb").isNotNull(), method[1]).alias("method"),
    )


def resolve_cascade(df: DataFrame, key: str, rules: Sequence[DataFrame | tuple[Column, DataFrame]]) -> DataFrame:
    """(key, target, rule): the first rule that names exactly one target for a row wins.

    Each rule is a table (key, target), or a value of the row and a table (value, target) that it is looked up in. A rule with
    several targets for a key names none, and later rules may then decide. Tables are brought down to the least and
    the greatest target of each value first, which tell one target from several, so a value with many targets makes one row.
    """
    met, best = df, []
    for i, rule in enumerate(rules):
        value, targets = rule if isinstance(rule, tuple) else (F.col(key), rule.select(F.col(key).alias("value"), "target"))
        ends = targets.where("value IS NOT NULL").groupBy(F.col("value").alias(f"__v{i}")).agg(F.min("target").alias(f"__lo{i}"), F.max("target").alias(f"__hi{i}"))
        met = met.withColumn(f"__k{i}", value).join(ends, F.col(f"__k{i}") == F.col(f"__v{i}"), "left")
        lo, hi = F.min(f"__lo{i}"), F.max(f"__hi{i}")
        best.append(F.when(lo == hi, F.struct(lo.alias("target"), F.lit(i).alias("rule"))))
    return met.groupBy(key).agg(F.coalesce(*best).alias("b")).select(key, "b.target", "b.rule")


def with_endpoints(edges: DataFrame, nodes: DataFrame, node_key: str, label: str, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Edges with the label of both ends; edges that miss an end go."""
    for end in ends:
        names = nodes.select(F.col(node_key).alias(f"__{end}"), F.col(label).alias(f"{end}_{label}"))
        edges = edges.join(names, edges[end] == F.col(f"__{end}")).drop(f"__{end}")
    return edges


def either_end(edges: DataFrame, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both orientations of each edge as (node, other, ...): an OR join becomes an equi-join."""
    rest = [c for c in edges.columns if c not in ends]
    one = edges.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("other"), *rest)
    return one.unionByName(edges.select(F.col(ends[1]).alias("node"), F.col(ends[0]).alias("other"), *rest))
