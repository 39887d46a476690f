"""Sort modes, rank sorts and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by(column: str, descending: bool = False) -> Column:
    """Nulls last in both directions."""
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def rank_of(column: str, order: Sequence[str]) -> Column:
    """Place in a list of values; others come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 60) -> DataFrame:
    """A page of the sorted rows; numbers outside the range give the first or last page."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def record_tier(years: Column, tiers: Sequence[int] = (50, 30, 20, 10)) -> Column:
    """The largest tier the years reach, else null."""
    out = F.lit(None).cast("int")
    for t in sorted(tiers):
        out = F.when(years >= t, t).otherwise(out)
    return out
