"""The gate over a catalogue: all its rules, with one pass over each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.quality import wide_types
from fathomline.sources.catalog import Catalog


@dataclass(frozen=True)
class Refers:
    """Rows whose non-null reference has no parent; with ``required`` a null has none either."""

    table: str
    name: str
    column: str
    parent: str
    key: str
    required: bool = False
    where: str | None = None


@dataclass(frozen=True)
class Holds:
    """Rows for which a condition, in SQL, says that something is wrong; a null says nothing."""

    table: str
    name: str
    wrong: str


@dataclass(frozen=True)
class Once:
    """Keys with several rows that meet a condition."""

    table: str
    name: str
    key: str
    where: str


#: The columns that each layered table must have.
COLUMNS = {
    "spheres": "slug label description", "ecosystem_types": "slug label source description", "life_zones": "slug label holdridge_class",
    "facility_spheres": "facility_id sphere_slug role", "facility_ecosystems": "facility_id ecosystem_slug", "facility_life_zones": "facility_id life_zone_slug",
    "data_archives": "archive_id name organization archive_type base_url api_url api_type license_slug", "facility_archives": "facility_id archive_id role scope_url",
    "data_products": "product_id archive_id facility_id title doi url format_slug license_slug source confidence", "api_endpoints": "endpoint_id archive_id path_or_url method",
    "cloud_buckets": "bucket_id archive_id provider bucket_name",
    "person_registry": "canonical_id display_name orcid openalex_id is_site_personnel is_scholar person_id tier tier_rank lto_works_count lto_share source_url confidence",
    "person_identity_source": "canonical_id field value method confidence", "registry_collaborations": "canonical_id_a canonical_id_b co_pub_count first_year last_year",
    "registry_facilities": "canonical_id facility_id method ror", "person_validation": "validation_id canonical_id check_id verdict method source_url retrieved_at confidence run_id",
    "coauthor_edges": "edge_id canonical_id_a canonical_id_b co_pub_count exemplar_work_id match_method source_url retrieved_at confidence run_id",
    "coauthor_candidates": "candidate_id display_name openalex_id seen_with_canonical_id seen_on_work_id n_registry_coauthors decision source_url retrieved_at confidence run_id",
}
#: Country -> boxes of (least latitude, greatest, least longitude, greatest); a place must lie in one of them.
BOXES = {
    "US": ((17.0, 72.0, -180.0, -64.0), (13.0, 21.0, 144.0, 146.5), (-15.0, 0.0, -172.0, -168.0), (5.0, 7.0, -163.0, -161.0), (18.0, 29.0, -178.5, -154.0)),
    "CA": ((41.0, 84.0, -142.0, -52.0),), "MX": ((14.0, 33.0, -118.0, -86.0),), "CU": ((19.5, 23.5, -85.5, -74.0),), "JM": ((17.5, 18.7, -78.5, -76.0),),
    "BS": ((20.5, 27.5, -79.5, -72.5),), "DO": ((17.5, 20.0, -72.0, -68.0),), "HT": ((17.5, 20.0, -74.5, -71.5),), "PR": ((17.8, 18.6, -67.3, -65.2),),
    "VI": ((17.6, 18.5, -65.1, -64.5),), "CO": ((-4.3, 13.0, -81.8, -66.8),), "BR": ((-34.0, 5.3, -74.0, -28.6),), "AR": ((-55.2, -21.8, -73.6, -53.6),),
    "CL": ((-56.0, -17.5, -75.7, -66.4),), "PE": ((-18.4, -0.1, -81.4, -68.6),), "EC": ((-5.1, 1.7, -92.1, -75.2),), "UY": ((-35.0, -30.0, -58.5, -53.0),),
    "VE": ((0.6, 12.3, -73.4, -59.8),), "PA": ((7.2, 9.7, -83.0, -77.2),), "CR": ((8.0, 11.3, -86.0, -82.5),), "GT": ((13.7, 17.9, -92.3, -88.2),),
    "BZ": ((15.9, 18.5, -89.3, -87.3),), "HN": ((12.9, 16.6, -89.4, -83.1),), "NI": ((10.7, 15.1, -87.7, -82.6),), "SV": ((12.9, 14.5, -90.2, -87.6),),
    "BB": ((13.0, 13.4, -60.0, -59.3),), "TT": ((10.0, 11.5, -62.0, -60.4),), "KY": ((19.2, 19.9, -81.5, -79.7),), "TC": ((20.9, 22.0, -72.5, -71.0),),
}


def _outside(country: str, boxes) -> str:
    within = " OR ".join(f"(hq_lat BETWEEN {a} AND {b} AND hq_lng BETWEEN {c} AND {d})" for a, b, c, d in boxes)
    return f"country = '{country}' AND hq_lat IS NOT NULL AND hq_lng IS NOT NULL AND NOT ({within})"


RULES = (
    Holds("facilities", "facility without type or country", "facility_type IS NULL OR country IS NULL"),
    Refers("facilities", "unknown facility type", "facility_type", "facility_types", "slug", required=True),
    Refers("facilities", "facility without provenance", "facility_id", "provenance", "record_id", required=True, where="record_type = 'facility'"),
    *(Holds("facilities", f"outside the boxes of {country}", _outside(country, boxes)) for country, boxes in BOXES.items()),
    Refers("facility_spheres", "unknown sphere", "sphere_slug", "spheres", "slug", required=True),
    Refers("facility_spheres", "sphere of an unknown facility", "facility_id", "facilities", "facility_id", required=True),
    Once("facility_spheres", "several primary spheres", "facility_id", "role = 'primary'"),
    Refers("facility_life_zones", "unknown life zone", "life_zone_slug", "life_zones", "slug", required=True),
    Refers("facility_ecosystems", "unknown ecosystem", "ecosystem_slug", "ecosystem_types", "slug", required=True),
    Refers("facility_archives", "unknown archive", "archive_id", "data_archives", "archive_id", required=True),
    Refers("facility_archives", "archive of an unknown facility", "facility_id", "facilities", "facility_id", required=True),
    Holds("data_archives", "archive without url", "base_url IS NULL OR base_url = ''"),
    Refers("data_products", "product of an unknown archive", "archive_id", "data_archives", "archive_id"),
    Holds("person_registry", "person without identifier", "orcid IS NULL AND openalex_id IS NULL"),
    Holds("person_registry", "malformed key", "NOT (canonical_id LIKE 'orcid:%' OR canonical_id LIKE 'openalex:%')"),
    Holds("person_registry", "unknown tier", "tier NOT IN ('core', 'archive')"),
    Holds("person_registry", "key and ORCID differ", "canonical_id LIKE 'orcid:%' AND canonical_id <> concat('orcid:', orcid)"),
    *(rule for t in ("registry_collaborations", "coauthor_edges") for rule in (
        Holds(t, f"{t} out of order", "canonical_id_a >= canonical_id_b"),
        Refers(t, f"{t} without its first end", "canonical_id_a", "person_registry", "canonical_id", required=True),
        Refers(t, f"{t} without its second end", "canonical_id_b", "person_registry", "canonical_id", required=True))),
)


def _of_table(df: DataFrame, catalog: Catalog, rules: list) -> DataFrame:
    """(rule, violations) of the row rules of one table, from one pass with a look-up for each reference."""
    rows, counts = df, []
    for i, r in enumerate(rules):
        if isinstance(r, Holds):
            counts.append((r.name, F.expr(r.wrong)))
            continue
        parent = catalog.get(r.parent)
        if parent is None:  # nothing is known, so all are
            counts.append((r.name, F.lit(True) if r.required else F.col(r.column).isNotNull()))
            continue
        keys = (parent.where(r.where) if r.where else parent).select(F.col(r.key).alias(f"__k{i}")).where(f"__k{i} IS NOT NULL").distinct()
        rows = rows.join(keys, F.col(r.column) == F.col(f"__k{i}"), "left")
        counts.append((r.name, F.col(f"__k{i}").isNull() & (F.lit(True) if r.required else F.col(r.column).isNotNull())))
    sums = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(counts)))
    each: list[Column] = [F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("violations")) for i, (name, _) in enumerate(counts)]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def gate(catalog: Catalog, views: dict[str, DataFrame] | None = None, rules: tuple = RULES, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """(rule, violations, passed) of a catalogue of tables.

    Tables that lack fail the rule ``missing table`` once any layered table has a row, and missing columns fail ``missing column``; rules that ask for a table or
    column that isn't there say nothing else. Views fail ``wide number`` for each column that a browser can't read as a number. A table's
    row rules share one pass; parents' keys are folded first, so repeated ones count once.
    """
    spark, out = catalog.spark, None
    held = {name: catalog.get(name) for name in columns}
    full = any(df is not None and df.limit(1).count() for df in held.values())
    told = [("missing table", sum(df is None for df in held.values()) if full else 0),
            ("missing column", sum(len(set(columns[n].split()) - set(df.columns)) for n, df in held.items() if df is not None)),
            ("wide number", sum(len(wide_types(df)) for df in (views or {}).values()))]
    found = [spark.createDataFrame(told, "rule string, violations long")]
    for table in dict.fromkeys(r.table for r in rules):
        df = catalog.get(table)
        if df is None:
            continue
        there = lambda r: isinstance(r, Refers) and r.column in df.columns or isinstance(r, Holds) and _resolves(df, r.wrong)  # noqa: B023, E731
        own = [r for r in rules if r.table == table and there(r)]
        if own:
            found.append(_of_table(df, catalog, own))
        for r in (r for r in rules if r.table == table and isinstance(r, Once) and r.key in df.columns):
            several = df.where(r.where).groupBy(r.key).agg(F.count("*").alias("n")).where("n > 1")
            found.append(several.agg(F.count("*").alias("violations")).select(F.lit(r.name).alias("rule"), "violations"))
    for one in found:
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("violations") == 0)


def _resolves(df: DataFrame, condition: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(df.limit(0).where(condition).columns)
    except AnalysisException:
        return False
