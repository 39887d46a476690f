"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.plans import canned, edges, filters, funding, further, layouts, linkage, matching, measures, products, resolution, semantics, shapes2d, space, upserts

_PLANS = [m.PLANS for m in (funding, filters, edges, measures, upserts, resolution, linkage, space, canned, further, matching, semantics, products, shapes2d, layouts)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for plans in _PLANS for name, run in plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in _PLANS for name, sql in plans.oracles.items()}
