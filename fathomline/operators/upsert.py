"""Insert, replace, merge, delete and patch semantics over immutable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.keys import _cols


def insert_ignore(stored: DataFrame, new: DataFrame, key: str | Sequence[str], seq: str | None = None) -> DataFrame:
    """Stored rows win; of new rows with one key the first by ``seq`` is kept."""
    fresh = new.join(stored.select(*_cols(key)), _cols(key), "left_anti")
    if seq:
        w = Window.partitionBy(*_cols(key)).orderBy(seq)
        fresh = fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", seq)
    else:
        fresh = fresh.dropDuplicates(_cols(key))
    return stored.unionByName(fresh.select(*stored.columns))


def insert_replace(stored: DataFrame, new: DataFrame, key: str | Sequence[str], seq: str) -> DataFrame:
    """New rows win; of several with one key the last by ``seq`` is kept."""
    w = Window.partitionBy(*_cols(key)).orderBy(F.desc(seq))
    last = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*stored.columns)
    return stored.join(last.select(*_cols(key)), _cols(key), "left_anti").unionByName(last)


def merge(stored: DataFrame, new: DataFrame, key: str | Sequence[str], prefer: str = "new") -> DataFrame:
    """Full outer merge by column: ``prefer`` says whose non-null value wins ("new" or "stored")."""
    keys = _cols(key)
    renamed = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in new.columns if c not in keys))
    order = (lambda c: (f"__{c}", c)) if prefer == "new" else (lambda c: (c, f"__{c}"))
    return stored.join(renamed, keys, "full").select(
        *keys, *(F.coalesce(*order(c)).alias(c) if f"__{c}" in renamed.columns else F.col(c) for c in stored.columns if c not in keys)
    )


def replace_owned(stored: DataFrame, new: DataFrame, owner: str, value: str) -> DataFrame:
    """Rows of one owner are replaced by the new ones; others survive, a null owner too."""
    return stored.where(~F.col(owner).eqNullSafe(F.lit(value))).unionByName(new.select(*stored.columns))


def apply_patches(stored: DataFrame, log: DataFrame, key: str, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """A log (key, field, new_value, seq) applied newest first; field ``DELETE-ROW`` drops the row.

    Unknown keys and fields have no effect. Values are cast to the column's type.
    """
    w = Window.partitionBy(key, "field").orderBy(F.desc(seq))
    newest = log.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    gone = newest.where("field = 'DELETE-ROW'").select(key)
    wide = newest.where(F.col("field").isin(*fields)).groupBy(key).pivot("field", list(fields)).agg(F.first("new_value"))
    types = dict(stored.dtypes)
    renamed = wide.select(F.col(key).alias("__key"), *(F.col(f).alias(f"__{f}") for f in fields))
    patched = stored.join(gone, key, "left_anti").join(renamed, F.col(key) == F.col("__key"), "left")
    return patched.select(*(
        F.coalesce(F.col(f"__{c}").cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns
    ))


def rejected_patches(stored: DataFrame, log: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Log rows with an unknown key or field, with the reason."""
    known = stored.select(F.col(key).alias("__key")).distinct()
    return log.join(known, log[key] == F.col("__key"), "left").select(
        *log.columns,
        F.when(F.col("__key").isNull(), "unknown key").when(~F.col("field").isin("DELETE-ROW", *fields), "unknown field").alias("reason"),
    ).where("reason IS NOT NULL")


def compare_and_set(stored: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Changes (key, expected, value) apply only where the column still holds what was expected."""
    c = changes.select(F.col(key).alias("__key"), "expected", "value")
    hit = (F.col(key) == F.col("__key")) & F.col(column).eqNullSafe(F.col("expected"))
    return stored.join(c, hit, "left").select(*(
        F.when(F.col("__key").isNotNull(), F.col("value")).otherwise(F.col(column)).alias(column) if x == column else F.col(x)
        for x in stored.columns
    ))


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {name: df.join(keys.select(key), key, "left_anti") for name, df in tables.items()}


def flip_primary(links: DataFrame, owners: DataFrame, owner: str, value: str, new_primary: str, others: Sequence[str] = ()) -> DataFrame:
    """For the given owners: old primaries become secondary, ``new_primary`` the primary, others are added."""
    marked = links.join(owners.select(owner).withColumn("__in", F.lit(True)), owner, "left")
    kept = marked.where(~(F.coalesce("__in", F.lit(False)) & F.col(value).isin(new_primary))).withColumn(
        "is_primary", F.when(F.coalesce("__in", F.lit(False)), F.lit(False)).otherwise(F.col("is_primary"))
    ).select(*links.columns)
    added = owners.select(owner).distinct().select(
        owner, F.explode(F.array(*(F.struct(F.lit(v).alias(value), F.lit(v == new_primary).alias("is_primary")) for v in (new_primary, *others)))).alias("x")
    ).select(owner, f"x.{value}", "x.is_primary")
    return insert_ignore(kept, added.select(*links.columns), [owner, value])


def conforming(df: DataFrame, target: dict[str, str]) -> DataFrame:
    """Columns in the target's order and types; a missing column is an error."""
    missing = [c for c in target if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in target.items()))


def with_missing(df: DataFrame, target: dict[str, str]) -> DataFrame:
    """As conforming, but columns that an older table lacks are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in target.items()))
