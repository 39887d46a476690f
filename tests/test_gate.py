"""Each rule of the gate with a table that fails it."""

import pytest

from fathomline.operators.gate import BOXES, COLUMNS, RULES, gate
from fathomline.sources.catalog import Catalog

TABLES = {
    "facilities": ("facility_id string, facility_type string, country string, hq_lat double, hq_lng double", [
        ("f1", "lab", "US", 40.0, -100.0), ("f2", "lab", "US", 14.0, 145.0), ("f3", "odd", None, None, None), ("f4", "lab", "US", 40.0, 10.0), ("f5", None, "CA", 10.0, -60.0)]),
    "facility_types": ("slug string", [("lab",), ("lab",)]),
    "provenance": ("record_type string, record_id string", [("facility", "f1"), ("facility", "f2"), ("person", "f3"), ("facility", "f4"), ("facility", "f5")]),
    "spheres": ("slug string, label string, description string", [("bio", "b", None)]),
    "facility_spheres": ("facility_id string, sphere_slug string, role string", [("f1", "bio", "primary"), ("f1", "bio", "primary"), ("f9", "geo", "second")]),
    "life_zones": ("slug string, label string, holdridge_class string", [("z", None, None)]),
    "facility_life_zones": ("facility_id string, life_zone_slug string", [("f1", "z"), ("f1", "y")]),
    "ecosystem_types": ("slug string, label string, source string, description string", [("e", None, None, None)]),
    "facility_ecosystems": ("facility_id string, ecosystem_slug string", [("f1", "e"), ("f1", None)]),
    "data_archives": ("archive_id string, base_url string", [("a", "u"), ("b", ""), ("c", None)]),
    "facility_archives": ("facility_id string, archive_id string, role string, scope_url string", [("f1", "a", None, None), ("f8", "x", None, None)]),
    "data_products": ("product_id string, archive_id string", [("p", None), ("q", "zz"), ("r", "a")]),
    "person_registry": ("canonical_id string, orcid string, openalex_id string, tier string", [
        ("orcid:1", "1", None, "core"), ("openalex:A", None, "A", "archive"), ("orcid:2", "3", None, "core"), ("x:4", None, None, "odd")]),
    "registry_collaborations": ("canonical_id_a string, canonical_id_b string", [("openalex:A", "orcid:1"), ("orcid:1", "openalex:A"), ("orcid:1", "zz")]),
}
WANT = {
    "facility without type or country": 2, "unknown facility type": 2, "facility without provenance": 1, "outside the boxes of US": 1, "outside the boxes of CA": 1,
    "unknown sphere": 1, "sphere of an unknown facility": 1, "several primary spheres": 1, "unknown life zone": 1, "unknown ecosystem": 1, "unknown archive": 1,
    "archive of an unknown facility": 1, "archive without url": 2, "product of an unknown archive": 1, "person without identifier": 1, "malformed key": 1, "unknown tier": 1,
    "key and ORCID differ": 1, "registry_collaborations out of order": 1, "registry_collaborations without its first end": 0, "registry_collaborations without its second end": 1,
    "wide number": 1,
}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gate")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Catalog(spark, str(folder))


def test_every_rule_fails_where_it_should(spark, catalog):
    found = {r.rule: (r.violations, r.passed) for r in gate(catalog, {"view": spark.sql("SELECT 1.5BD AS wide, 1.5D AS plain")}).collect()}
    assert {k: v for k, (v, _) in found.items() if k in WANT} == WANT
    assert all(p == (v == 0) for v, p in found.values())
    assert all(found[f"outside the boxes of {c}"][0] == 0 for c in BOXES if c not in ("US", "CA"))
    assert found["missing table"][0] == len(set(COLUMNS) - set(TABLES))
    lacking = sum(len(set(COLUMNS[t].split()) - {c.split()[0] for c in TABLES[t][0].split(", ")}) for t in COLUMNS if t in TABLES)
    assert found["missing column"][0] == lacking and len(RULES) > 22


def test_an_empty_catalogue_passes(spark, tmp_path):
    assert [(r.violations, r.passed) for r in gate(Catalog(spark, str(tmp_path))).collect()] == [(0, True)] * 3
