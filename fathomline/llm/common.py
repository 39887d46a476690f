"""Helpers shared by the operators: the shared folder, written tables and Arrow output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent in a local session (tests) does a new local folder take its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathomline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of at most so many rows and bytes may be sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a column in a row, by its own length where that varies."""
    at = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(at), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(at))), F.lit(0))
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """A broadcast only behind a count of rows and bytes; larger tables are shuffled."""
    width = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(16))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def arrow_rows(
    df: DataFrame, schema: str, f: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]
) -> DataFrame:
    """mapInArrow over column dictionaries. ``f`` gets each batch as lists and yields lists."""
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(out)
        for made in f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[x.name], x.type) for x in fields], schema=fields
            )

    return df.mapInArrow(run, out)
