"""Ordered lists of structs and sets as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_structs(order: Sequence[tuple[str, bool]], payload: Sequence[str]) -> Column:
    """Aggregate: the payload structs of a group, ordered by (column, descending) with nulls last."""
    keyed = F.struct(*(F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(order)), F.struct(*payload).alias("payload"))

    def compare(a, b):
        out = F.lit(0)
        for i, (_, down) in reversed(list(enumerate(order))):
            x, y = a[f"k{i}"], b[f"k{i}"]
            less, more = (1, -1) if down else (-1, 1)
            out = (
                F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1)
                .when(x < y, less).when(x > y, more).otherwise(out)
            )
        return out

    return F.transform(F.array_sort(F.collect_list(keyed), compare), lambda s: s["payload"])


def sorted_set(column: str | Column) -> Column:
    """Aggregate: distinct non-null values in order."""
    return F.array_sort(F.collect_set(column))


def joined_set(column: str | Column, separator: str = "|") -> Column:
    """Aggregate: distinct non-null values in order, as one string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def merged_lists(a: str, b: str) -> Column:
    """Union of two lists in first-seen order; null lists are empty."""
    empty = F.array()
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def chips(column: str, most: int) -> Column:
    """The first items and a "+N more" mark."""
    n = F.size(column)
    shown = F.array_join(F.slice(column, 1, most), ", ")
    return F.when(n > most, F.concat(shown, F.lit(" +"), (n - most).cast("string"), F.lit(" more"))).otherwise(shown)
