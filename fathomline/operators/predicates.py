"""Filters built from facet state, text search, bands and ordered rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Facets:
    """State of a faceted search. Empty parts add no condition; parts AND, values OR."""

    values: dict[str, Sequence] = field(default_factory=dict)
    linked: dict[str, tuple[DataFrame, str, Sequence]] = field(default_factory=dict)
    flags: Sequence[str] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    text: str = ""
    text_columns: Sequence[str] = ()

    def condition(self) -> Column:
        """All parts that read the table itself."""
        parts = [F.col(c).isin(*v) for c, v in self.values.items() if v]
        parts += [F.col(c) for c in self.flags]
        for c, (low, high) in self.ranges.items():
            if low is not None or high is not None:
                parts.append(F.col(c).isNotNull())
            if low is not None:
                parts.append(F.col(c) >= low)
            if high is not None:
                parts.append(F.col(c) <= high)
        if self.text.strip():
            parts.append(contains_any(self.text_columns, self.text))
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """The matching rows; each linked facet {key: (links, value column, values)} is a semi-join."""
        df = df.where(self.condition())
        for key, (links, column, values) in self.linked.items():
            if values:
                df = df.join(links.where(F.col(column).isin(*values)).select(key), key, "left_semi")
        return df


def contains_any(columns: Iterable[str], text: str) -> Column:
    """Case-insensitive substring in any of the columns; null columns don't match."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))
    return out


def haystack(text: str, scalars: Sequence[str] = (), lists: Sequence[str] = ()) -> Column:
    """Substring search over scalar and array columns joined by blanks."""
    return F.contains(F.lower(F.concat_ws(" ", *scalars, *lists)), F.lit(text.strip().lower()))


def band(value: Column, bounds: Sequence[tuple[float, str]], above: str, missing: str) -> Column:
    """The label of the first bound that the value is under; ``missing`` for null."""
    out = F.when(value.isNull(), missing)
    for limit, label in bounds:
        out = out.when(value < limit, label)
    return out.otherwise(above)


def first_rule(text: Column, rules: Sequence[tuple[str, str | None]], otherwise: Column | None = None) -> Column:
    """Of (pattern, value) rules the first whose pattern is found decides; value None gives null."""
    out = None
    for pattern, value in rules:
        hit = text.rlike(pattern)
        out = (F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value)))
    return out.otherwise(otherwise if otherwise is not None else F.lit(None))


def outside_boxes(points: DataFrame, boxes: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Points outside every box (group, x0, x1, y0, y1) of their group; groups without a box pass none."""
    b = boxes.withColumnRenamed(group, "__g")
    inside = (F.col(group) == F.col("__g")) & F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return points.join(boxes.select(group).distinct(), group, "left_semi").join(b, inside, "left_anti")


def token_flag(column: str, flag: str) -> Column:
    """Membership in a comma-joined list of flags."""
    return F.array_contains(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), flag)
