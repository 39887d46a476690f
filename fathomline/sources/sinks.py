"""Writers: exports, caches, GeoJSON, manifests and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.catalog import Catalog


def export(catalog: Catalog, names: list[str], folder: str, where: dict[str, str] | None = None) -> dict[str, str]:
    """Each table as Parquet under ``folder``; missing tables are told and skipped."""
    told = {}
    for n in names:
        df = catalog.get(n)
        if df is None:
            told[n] = "missing"
            continue
        try:
            (df.where(where[n]) if where and n in where else df).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{n}.parquet")
            told[n] = "written"
        except AnalysisException as e:
            told[n] = f"failed: {e.getMessage()[:100]}"
    return told


def closed_edges(edges: DataFrame, nodes: DataFrame, key: str, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Edges whose both ends are among the nodes that ship."""
    for end in ends:
        edges = edges.join(nodes.select(F.col(key).alias(end)), end, "left_semi")
    return edges


def feature_lines(df: DataFrame, lng: str, lat: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature as text per row with coordinates."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    kept = df.where(F.col(lng).isNotNull() & F.col(lat).isNotNull())
    return kept.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def cache_json(df: DataFrame, folder: str) -> None:
    """Compact JSON rows; null items of list columns are dropped first."""
    lists = [c for c, t in df.dtypes if t.startswith("array")]
    df.withColumns({c: F.filter(c, lambda x: x.isNotNull()) for c in lists}).write.mode("overwrite").json(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def preflight(catalog: Catalog, expected: list[str], present: list[str]) -> dict[str, list[str]]:
    """Tables that a publication lacks and those that it has too many."""
    return {"missing": sorted(n for n in expected if catalog.get(n) is None), "extra": sorted(set(present) - set(expected))}


def append_log(df: DataFrame, folder: str) -> None:
    df.write.mode("append").option("header", "true").csv(folder)


def turtle(triples: DataFrame) -> DataFrame:
    """(s, p, o) rows as lines; objects that aren't IRIs are quoted."""
    slashed = F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    quoted = F.concat(F.lit('"'), slashed, F.lit('"'))
    o = F.when(F.col("o").rlike(r"^https?://\S+$"), F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(quoted)
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def bundle(archives: DataFrame, products: DataFrame, key: str, top: int = 10) -> DataFrame:
    """(key, text): a markdown page per archive with its most cited products, rendered in the plan."""
    from fathomline.operators.keys import top_per_group
    from fathomline.operators.nested import ordered_structs
    from fathomline.operators.sorting import by

    best = top_per_group(products, key, [by("cited_by_count", True), by("title")], top)
    listed = best.groupBy(key).agg(ordered_structs([("cited_by_count", True), ("title", False)], ["title", "cited_by_count"]).alias("p"))
    line = lambda p: F.concat(F.lit("- "), p["title"], F.coalesce(F.concat(F.lit(" ("), p["cited_by_count"].cast("string"), F.lit(" citations)")), F.lit("")))
    body = F.array_join(F.transform(F.coalesce("p", F.array()), line), "\n")
    joined = archives.join(listed, key, "left")
    return joined.select(key, F.concat(F.lit("---\nname: "), F.col("name"), F.lit("\n---\n\n# "), F.col("name"), F.lit("\n\n## Products\n\n"), body, F.lit("\n")).alias("text"))
