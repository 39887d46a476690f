"""Snapshots to read as of, staged publication behind a pointer, and loads that count what they drop."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.catalog import Catalog
from fathomline.sources.sinks import preflight

_ENTRY = "table string, path string, rows long, digest string"


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table's content in one pass, whatever the order of rows, the number of files or their size.

    The digest joins the exclusive or and the sum of 64-bit row hashes; equal rows cancel out in the first and not in the second.
    Map columns have no hash in Spark and are taken as JSON text.
    """
    plain = [F.to_json(c) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    row = F.xxhash64(*plain) if plain else F.lit(0).cast("long")
    n, one, two = df.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    return n, f"{(one or 0) & (1 << 64) - 1:016x}{int(two or 0) & (1 << 64) - 1:016x}"


def _numbered(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{_ENTRY}, number long").parquet(folder)
    except AnalysisException:
        return None


class Snapshots:
    """Versions of a set of tables under one folder.

    Each commit writes new files for the tables it is given, never touches older ones, and ends with one manifest file, which
    appears by a rename: a commit that dies leaves files that no manifest names. Tables that a commit doesn't give stay as they were.
    Two commits at once may choose one number; the second then fails. An empty folder has no snapshot.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifests(self) -> DataFrame | None:
        return _numbered(self.spark, f"{self.folder}/_manifests")

    def latest(self) -> int:
        """The highest snapshot number; 0 where there is none."""
        held = self._manifests()
        return 0 if held is None else held.agg(F.max("number")).first()[0] or 0

    def entries(self, number: int | None = None) -> dict[str, tuple[str, int, str]]:
        """Table -> (path, rows, digest) of a snapshot, the latest by default; one row a table reaches the driver."""
        number = self.latest() if number is None else number
        held = self._manifests()
        found = {} if held is None else {r.table: (r.path, r.rows, r.digest) for r in held.where(F.col("number") == number).collect()}
        if not found and number:
            raise KeyError(f"no snapshot {number}")
        return found

    def commit(self, tables: dict[str, DataFrame]) -> int:
        number = self.latest() + 1
        entries = self.entries(number - 1)
        for name, df in tables.items():
            path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            entries[name] = (path, *content_digest(self.spark.read.schema(df.schema).parquet(path)))
        rows = [(name, *entry) for name, entry in sorted(entries.items())]
        self.spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/_manifests/number={number}")
        return number

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a snapshot, the latest by default."""
        entries = self.entries(number)
        if name not in entries:
            raise KeyError(name)
        return self.spark.read.parquet(entries[name][0])

    def changes(self, name: str, key: str, before: int, after: int) -> DataFrame:
        """(key, change, before, after): rows added, removed or changed between two snapshots, whole rows as structs; keys are unique."""
        old, new = self.read(name, before), self.read(name, after)
        a, b = old.select(F.col(key).alias("__a"), F.struct(*old.columns).alias("before")), new.select(F.col(key).alias("__b"), F.struct(*new.columns).alias("after"))
        both = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full")
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.to_json("before").eqNullSafe(F.to_json("after")), "changed")
        return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change"), "before", "after").where("change IS NOT NULL")


def publish(catalog: Catalog, expected: Sequence[str], present: Sequence[str], root: str) -> int:
    """Publish the expected tables as a release and return its number.

    A table that is missing, or present and not expected, stops it before anything is written. Tables are written to a staging
    folder of their own and read back; if one differs from its source, the release isn't pointed to. Readers follow the pointer, so they see
    the whole old or the whole new release.
    """
    problems = {k: v for k, v in preflight(catalog, list(expected), list(present)).items() if v}
    if problems:
        raise ValueError("; ".join(f"{k}: {', '.join(v)}" for k, v in problems.items()))
    spark, staging = catalog.spark, f"{root.rstrip('/')}/staging-{uuid.uuid4().hex}"
    rows = []
    for name in expected:
        path = f"{staging}/{name}.parquet"
        catalog.get(name).write.option("compression", "zstd").parquet(path)
        told, held = content_digest(catalog.get(name)), content_digest(spark.read.schema(catalog.get(name).schema).parquet(path))
        if told != held:
            raise ValueError(f"{name} changed while it was written")
        rows.append((name, path, *held))
    pointers = f"{root.rstrip('/')}/_releases"
    held = _numbered(spark, pointers)
    number = 1 + (0 if held is None else held.agg(F.max("number")).first()[0] or 0)
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{pointers}/number={number}")
    return number


def released(spark: SparkSession, root: str, number: int | None = None) -> dict[str, tuple[str, int, str]]:
    """Table -> (path, rows, digest) of a release, the latest by default; empty where there is none."""
    held = _numbered(spark, f"{root.rstrip('/')}/_releases")
    if held is None:
        return {}
    number = held.agg(F.max("number")).first()[0] if number is None else number
    return {r.table: (r.path, r.rows, r.digest) for r in held.where(F.col("number") == number).collect()}


def _marked(child: DataFrame, parents: Sequence[tuple[str, DataFrame, str]]) -> tuple[DataFrame, list[Column]]:
    rows, holds = child, []
    for i, (column, parent, key) in enumerate(parents):
        keys = parent.select(F.col(key).alias(f"__p{i}")).where(f"__p{i} IS NOT NULL").distinct()
        rows = rows.join(keys, F.col(f"`{column}`") == F.col(f"__p{i}"), "left")
        holds.append(F.col(f"`{column}`").isNull() | F.col(f"__p{i}").isNotNull())
    return rows, holds


def load(child: DataFrame, parents: Sequence[tuple[str, DataFrame, str]], path: str) -> dict[str, int]:
    """Write the rows of ``child`` whose references (column, parent, parent's key) are null or known; the counts come from the same pass.

    Returns ``read``, ``written``, ``dropped`` and for each column how many rows it sent away (a row may fail several). Repeated parent keys don't repeat rows.
    """
    rows, holds = _marked(child, parents)
    whole = F.lit(True)
    for h in holds:
        whole = whole & h
    seen = Observation()
    counts = [F.count_if(~h).alias(column) for (column, _, _), h in zip(parents, holds, strict=True)]
    observed = rows.observe(seen, F.count("*").alias("read"), F.count_if(whole).alias("written"), *counts)
    observed.where(whole).select(*child.columns).write.mode("overwrite").parquet(path)
    told = {k: int(v) for k, v in seen.get.items()}
    return told | {"dropped": told["read"] - told["written"]}


def orphans(child: DataFrame, parents: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(column, rows, values): what load would send away, by reference."""
    rows, holds = _marked(child, parents)
    each = F.array(*(F.struct(F.lit(column).alias("column"), F.col(f"`{column}`").cast("string").alias("v"), (~h).alias("bad")) for (column, _, _), h in zip(parents, holds, strict=True)))
    return rows.select(F.explode(each).alias("x")).where("x.bad").groupBy("x.column").agg(F.count("*").alias("rows"), F.countDistinct("x.v").alias("values"))
