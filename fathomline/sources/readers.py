"""Readers for the file shapes the catalogue is fed with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: str, comment: str | None = None, bad: str = "DROPMALFORMED") -> DataFrame:
    """CSV with a header, quoted commas, doubled quotes and optional comment lines."""
    options = {"header": "true", "quote": '"', "escape": '"', "mode": bad, "multiLine": "true", "enforceSchema": "false"}
    reader = spark.read.schema(schema).options(**options)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def shards(spark: SparkSession, folder: str, schema: str | StructType | None = None) -> DataFrame:
    """A folder of part files; a schema spares reading a footer first."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(folder)


def json_arrays(spark: SparkSession, path: str, schema: StructType, skip: str | None = None) -> DataFrame:
    """Files that each hold a JSON array of records: one row per record, with its file.

    Files that aren't valid or aren't arrays give no rows; paths that match ``skip`` are left out.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    if skip:
        text = text.where(~F.col("file").rlike(skip))
    kind = f"array<{schema.simpleString()}>"
    rows = text.select("file", F.explode(F.from_json("value", kind)).alias("r"))
    return rows.where("r IS NOT NULL").select("r.*", "file")


def ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON record a line; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def any_shape(text: Column, record: str, keys: tuple[str, ...]) -> Column:
    """Records of a JSON text that is an array, or an object that wraps one under one of ``keys``."""
    wrapped = [F.from_json(F.get_json_object(text, f"$.{k}"), f"array<{record}>") for k in keys]
    return F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, f"array<{record}>")), *wrapped, F.expr(f"CAST(array() AS array<{record}>)"))


def nested_tables(df: DataFrame, lists: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A table for each nested array: the array's fields beside the given outer columns."""
    return {name: df.select(*keys, F.explode(name).alias("__r")).select(*keys, "__r.*") for name, keys in lists.items()}


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON file: property columns, kind and polygons (polygon, ring, (x, y)).

    Features without a name, or without polygon coordinates, are skipped. Polygons and
    multi-polygons get one form.
    """
    shape = f"struct<features: array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    ring = "array<array<double>>"
    many = F.from_json("f.geometry.coordinates", f"array<array<{ring}>>")
    one = F.array(F.from_json("f.geometry.coordinates", f"array<{ring}>"))
    raw = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", one)
    points = F.transform("raw", lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))))
    named = rows.select("f", raw.alias("raw")).where("f.properties.name IS NOT NULL AND trim(f.properties.name) <> '' AND raw IS NOT NULL")
    return named.select("f.properties.*", F.col("f.geometry.type").alias("kind"), points.alias("polygons"))


def front_matter(text: Column) -> Column:
    """Flat ``key: value`` lines between the two dashes lines at the top, as a map."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda line: F.contains(line, F.lit(":")))
    keyed = F.transform(pairs, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("v")))
    return F.map_from_entries(keyed)


def authoritative(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """Of several sources for a key the best-ranked stays."""
    from fathomline.operators.keys import top_per_group

    return top_per_group(df, key, [rank])
