"""The judge of institution records against names that once misled it."""

import pytest

from fathomline.operators.institutions import judged_institutions


def rec(code, display, aliases=(), acronyms=(), country="US", status="active"):
    names = [(display, ["display", "label"]), *((a, ["alias"]) for a in aliases), *((a, ["acronym"]) for a in acronyms)]
    return (f"https://ror.org/{code}", status, country, names)


ARCHBOLD, ECO = "Archbold Biological Station", "Long Term Ecological Research"
#: (facility, acronym, candidates, institution, start of the decision)
CASES = [
    (ARCHBOLD, "ABS", [rec("a1", ARCHBOLD, acronyms=["ABS"])], "a1", "acronym-match"),
    ("Bonanza Creek LTER Caribou-Poker Creeks", None, [rec("a2", f"Bonanza Creek {ECO}", aliases=["Bonanza Creek LTER"])], "a2", "name-token-match"),
    ("Plum Island Ecosystems LTER", None, [rec("a3", f"Plum Island Ecosystems {ECO}")], "a3", "name-token-match"),
    ("ACE Basin NERR", None, [rec("a4", "Arkansas Department of Career Education", aliases=["ACE"])], None, "no-match"),
    ("Albemarle-Pamlico National Estuary Partnership", None, [rec("a5", "Lower Columbia Estuary Partnership")], None, "review-"),
    ("Beaufort Lagoon LTER", "LTER", [rec("a6", f"{ECO} Network", acronyms=["LTER"])], None, "review-head-token-missing"),
    ("Cape Lisburne Coast Guard / NSIDC Sea-Ice Site", None, [rec("a7", "United States Coast Guard")], None, "review-head-token"),
    ("Wells NERR", None, [rec("a8", "Wells Fargo (United States)")], None, "review-extra-token"),
    ("Point Reyes National Seashore", None, [rec("a9", "Point Blue Conservation Science")], None, "review-"),
    ("USDA Midwest Climate Hub", None, [rec("b1", "USDA California Climate Hub")], None, "review-extra-token-california"),
    ("University of Kansas Field Station", None, [rec("b2", "University of Kansas")], None, "review-parent-org"),
    ("Elkhorn Slough NERR", None, [rec("b3", "Elkhorn Slough Foundation")], None, "review-org-form-foundation"),
    ("National Estuarine Research Reserve System", None, [rec("b4", "National Estuarine Research Reserve Association")], None, "name-too-generic"),
    ("San Francisco Estuary Partnership NEP", None, [rec("b5", "San Francisco Estuary Institute")], None, "review-org-form-institute"),
    (ARCHBOLD, "ABS", [rec("b6", ARCHBOLD, country="AU")], None, "no-match"),
    (ARCHBOLD, "ABS", [rec("b7", ARCHBOLD, status="withdrawn")], None, "no-match"),
    ("Sevilleta LTER", None, [rec("b8", f"Sevilleta {ECO}"), rec("b9", f"Sevilleta {ECO}")], None, "ambiguous"),
    # the sixth candidate isn't looked at; nulls
    ("Konza Prairie", None, [*(rec(f"c{k}", f"Other {k} Place") for k in range(5)), rec("c6", "Konza Prairie")], None, "no-match"),
    (None, None, [rec("c7", "Anything")], None, "name-too-generic"),
    ("Toolik Field Station", "TFS", [], None, "no-match"),
    ("Toolik Field Station", "TFS", [("c8", None, None, [(None, None), ("Toolik Field Station", ["display"])])], "c8", "name-token-match"),
]


@pytest.fixture(scope="module")
def told(spark):
    facilities = [(k, name, acronym, "us") for k, (name, acronym, *_) in enumerate(CASES)]
    candidates = [(k, i, *c) for k, (_, _, items, *_) in enumerate(CASES) for i, c in enumerate(items)]
    found = judged_institutions(
        spark.createDataFrame(facilities, "facility int, name string, acronym string, country string"),
        spark.createDataFrame(candidates, "facility int, place int, id string, status string, country string, names array<struct<value: string, types: array<string>>>"))
    return {r.facility: r for r in found.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(told, k):
    _, _, _, institution, start = CASES[k]
    assert told[k].institution == institution and told[k].decision.startswith(start), told[k]


def test_rivals_are_named(told):
    assert told[16].matched == f"Sevilleta {ECO}; Sevilleta {ECO}" and len(told) == len(CASES)
