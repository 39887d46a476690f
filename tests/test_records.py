from datetime import date

from pyspark.sql import functions as F

from fathomline.operators import records
from fathomline.plans.views import Views
from fathomline.sources.catalog import Catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_duplicate_records(table):
    df = table([
        (1, "a", "http://x.org", "Ocean Lab", 1.0, 1.0), (2, "b", "https://www.x.org/", "Other", 50.0, 50.0),
        (3, "c", None, "lab ocean", 1.01, 1.0), (4, "d", None, "ocean lab", 9.0, 9.0), (5, "d", "", "Reef", None, None),
    ], "k int, id string, url string, name string, lat double, lng double")
    assert rows(records.duplicate_records(df, "k")) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_merge_prefers_confidence_then_order(table):
    df = table([(1, "", "low", 1, ["a"]), (1, "x", "low", 2, ["b", "a"]), (1, "y", "high", 3, None), (1, "z", "high", 4, ["c"]), (2, None, None, 5, None)],
               "g int, name string, confidence string, seq int, tags array<string>")
    assert {r.g: (r.name, r.tags) for r in records.merged_records(df, "g", ["name"], ["tags"]).collect()} == {1: ("y", ["a", "b", "c"]), 2: (None, [])}


def test_people_merge_and_children(table):
    people = table([(1, "Ann", None, "o1"), (2, "ann ", "e", "o2"), (3, "Bob", None, None)], "k int, name string, email string, orcid string")
    kept, moved = records.merged_people(people, "k", "name", ["orcid"])
    assert {r.k: (r.orcid, r.conflicts) for r in kept.collect()} == {2: (None, "orcid"), 3: (None, "")}
    assert rows(records.repointed(table([(1, "f"), (2, "f"), (3, "g")], "person int, f string"), "person", moved)) == [(2, "f"), (3, "g")]


def test_registry_joins_on_identifiers_only(table):
    df = table([(1, "s", "Ann", "o1", None), (2, "t", "A.", "o1", "A5"), (3, "u", "Ann", None, "A5"), (4, "s", "Ann", "o9", None), (5, "s", "Ann", None, None)],
               "seq int, source string, name string, orcid string, openalex_id string")
    persons, provenance = records.registry(df)
    assert {r.canonical_id: (r.sources, r.assertions) for r in persons.collect()} == {"o1": ("s,t,u", 3), "o9": ("s", 1)}
    assert provenance.count() == 4


def test_verdicts(table):
    df = table([(1, "x", True), (2, None, None), (3, "y", False), (4, "z", None)], "k int, orcid string, ok boolean")
    got = records.verdicts(df, "k", [("orcid", F.col("orcid").isNotNull(), F.col("ok"), F.col("orcid"))])
    assert rows(got.select("k", "verdict")) == [(1, "pass"), (2, "not_applicable"), (3, "fail"), (4, "unresolved")]


def test_scores_splits_urls_shapes(table):
    c = table([(1, 1, False, False), (5, 10, True, True), (20, 10, True, True)], "coauthors int, works int, has_ror boolean, has_orcid boolean")
    assert [r.priority for r in records.candidate_scores(c).collect()] == ["low", "medium", "high"]
    a, b = table([("o", "A1"), (None, "A2")], "orcid string, author string"), table([("o", "A1"), ("o", "A3")], "orcid string, author string")
    assert [r.other_id for r in records.split_identities(a, b, "orcid", "author").collect()] == ["A3"]
    assert rows(records.url_inventory([(table([("u",), ("",)], "x string"), "x", "one"), (table([(" u ",), (None,)], "y string"), "y", "two")])) == [("u", "one, two", 2)]
    n = table([(1, "person", None), (2, "person", "x"), (3, "edge", None)], "k int, kind string, orcid string")
    assert rows(records.shape_violations(n, "k", [("needs orcid", F.col("kind") == "person", F.col("orcid").isNotNull())])) == [(1, "needs orcid")]


def test_overlays(table):
    o, t = table([("a",), ("b",), ("c",)], "overlay string"), table([("a", "reef"), ("b", "lake"), ("c", "reef")], "overlay string, tag string")
    assert rows(records.hidden_overlays(o, t, ["reef"], ["c"])) == [("a", False), ("b", True), ("c", True)]
    assert not any(r.hidden for r in records.hidden_overlays(o, t, [], ["c"]).collect())


def test_judge(table):
    c = table([("f", "r1", 3, True), ("f", "r2", 2, True), ("g", "r3", 1, False), ("h", "r4", 2, True), ("h", "r5", 2, True)], "k string, candidate string, n int, country boolean")
    got = records.judged(c, "k", [("country", F.col("country")), ("tokens", F.col("n") > 1)], [-F.col("n")])
    assert rows(got) == [("f", "r1", "accepted"), ("g", None, "country"), ("h", None, "ambiguous")]


def test_views(spark, table, tmp_path):
    t = {
        "facilities": table([("f1", "Lab", "L", "t", "US", "r", 1.0, 2.0, "u", "p"), ("f2", "Empty", None, "t", "CA", None, None, None, None, None)],
                            "facility_id string, canonical_name string, acronym string, facility_type string, country string, region string, hq_lat double, hq_lng double, url string, parent_org string"),
        "area_links": table([("f1", "a1"), ("f1", "a2")], "facility_id string, area_id string"),
        "research_areas": table([("a1", "Coral"), ("a2", None)], "area_id string, label string"),
        "network_membership": table([("f1", "n1")], "facility_id string, network_id string"),
        "networks": table([("n1", "Net")], "network_id string, label string"),
        "funders": table([("u1", "NSF", "gov"), ("u2", "NGO", "ngo")], "funder_id string, name string, type string"),
        "funding_events": table([("e1", "u1", "f1", 10.0, 2020), ("e2", "u2", "f1", 5.0, 2020), ("e3", "u1", "f1", None, 2021), ("e4", "u1", "f2", 2.0, 1900)], "event_id string, funder_id string, facility_id string, amount_usd double, fiscal_year int"),
        "facility_regions": table([("f1", "g1")], "facility_id string, region_id string"),
        "regions": table([("g1", "Bay", "B", "k", "n1", "u", "m", 1990, "CA", "d")], "region_id string, name string, acronym string, kind string, network_id string, url string, manager string, designated int, state string, description string"),
        "region_area_links": table([("g1", "a1")], "region_id string, area_id string"),
        "cpi_index_us": table([(2020, 100.0), (2024, 120.0)], "year int, cpi_u double"),
        "people": table([("p1", "Ann", "A", None, None, None, None, None, None), ("p2", "Bob", "B", None, None, None, None, None, None)], "person_id string, name string, name_family string, orcid string, openalex_id string, email string, homepage_url string, research_interests string, status string"),
        "facility_personnel": table([("f1", "p1", "Director", "D", True, None, None, "s"), ("f1", "p1", "Chair", "C", True, None, date(2000, 1, 1), "s"), ("f1", "p2", "Tech", "T", False, None, None, "s")],
                                    "facility_id string, person_id string, role string, title string, is_key_personnel boolean, start_date date, end_date date, source_url string"),
        "person_areas": table([("p1", "a1", 0.5, 3, "x")], "person_id string, area_id string, weight double, evidence_count int, source string"),
        "authorship": table([("p1", "w1"), ("p1", "w2")], "person_id string, publication_id string"),
        "publications": table([("w1", 2001), ("w2", None)], "publication_id string, pub_year int"),
        "person_validation": table([("c1", "k1", "fail", "2024-01-01", "r1"), ("c1", "k1", "pass", "2024-01-01", "r2"), ("c2", "k1", "not_applicable", "2024-01-01", "r1")], "canonical_id string, check_id string, verdict string, retrieved_at string, run_id string"),
        "person_registry": table([("c1", "Ann", "core", "o", None, None, "u", "high", "X"), ("c2", "Bob", "archive", None, None, None, "", "odd", "Y")], "canonical_id string, display_name string, tier string, orcid string, openalex_id string, affiliation_ror string, source_url string, confidence string, affiliation string"),
        "coauthor_edges": table([("c1", "c2", 4)], "canonical_id_a string, canonical_id_b string, co_pub_count int"),
    }
    for name, df in t.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    v = Views(Catalog(spark, str(tmp_path)))
    rich = {r.facility_id: r for r in v.v_facility_enriched().collect()}
    assert (rich["f1"].research_areas, rich["f1"].funders, rich["f1"].regions) == (["Coral"], ["NGO", "NSF"], ["Bay"]) and rich["f2"].networks == []
    assert (rich["f1"].spheres, rich["f1"].ecosystem_types, rich["f1"].parent_org, rich["f1"].established) == ([], [], "p", None)
    more = {
        "facilities": table([("f1", "Lab", "L", "t", "US", 1.0, 2.0, "u", "p", 1950, 70, True, "d")], "facility_id string, canonical_name string, acronym string, facility_type string, country string, hq_lat double, hq_lng double, url string, parent_org string, established int, record_length_years int, long_term_threshold_met boolean, data_portal_url string"),
        "facility_spheres": table([("f1", "b"), ("f1", "a"), ("f1", "b"), ("f9", "a")], "facility_id string, sphere_slug string"),
        "spheres": table([("a", "Air"), ("b", "Biosphere")], "slug string, label string"),
        "facility_ecosystems": table([("f1", "e"), ("f1", "x")], "facility_id string, ecosystem_slug string"),
        "ecosystem_types": table([("e", "Estuary")], "slug string, label string"),
    }
    for name, df in (t | more).items():
        df.coalesce(1).write.parquet(f"{tmp_path}/more/{name}.parquet")
    one = Views(Catalog(spark, f"{tmp_path}/more")).v_facility_enriched().first()
    assert (one.spheres, one.ecosystem_types, one.established, one.record_length_years, one.long_term_threshold_met, one.data_portal_url) == (["Air", "Biosphere"], ["Estuary"], 1950, 70, True, "d")
    assert [r.id for r in v.v_facility_map().collect()] == ["f1"]
    assert rows(v.v_region_enriched().select("network_label", "facilities", "facility_count")) == [("Net", ["Lab"], 1)]
    assert rows(v.v_facility_funding_by_year().select("facility_id", "fiscal_year", "total_usd_nominal", "n_awards")) == [("f1", 2020, 15.0, 2), ("f2", 1900, 2.0, 1)]
    assert rows(v.v_funder_funding_by_year().select("funder", "fiscal_year", "n_facilities")) == [("NGO", 2020, 1), ("NSF", 1900, 1), ("NSF", 2020, 1)]
    assert rows(v.v_facility_funding_by_year_real().select("fiscal_year", "total_usd_real_2024")) == [(1900, None), (2020, 18.0)]
    assert [(r.name, r.role) for r in v.v_facility_key_personnel().collect()] == [("Ann", "Director")]
    people = {r.person_id: r for r in v.v_person_enriched().collect()}
    assert (people["p1"].roles, people["p1"].n_publications, people["p1"].latest_pub_year, people["p2"].n_publications) == (["Chair", "Director"], 2, 2001, 0)
    assert v.v_person_areas_enriched().first().facilities == ["Lab"]
    summary = {r.canonical_id: (r.n_pass, r.n_fail, r.pass_rate, r.has_persistent_id, r.has_valid_confidence) for r in v.v_person_validation_summary().collect()}
    assert summary == {"c1": (1, 0, 1.0, True, True), "c2": (0, 0, None, False, False)}
    assert (v.v_coauthor_edges_enriched().first().name_a, v.funding_links) and v.v_coauthor_edges_enriched().first().name_b == "Bob"
