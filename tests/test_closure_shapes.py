"""Closure beside a naive one over all pairs; each shape with a node that fails it."""

import random

from pyspark.sql import functions as F

from fathomline.operators import graph
from fathomline.operators.closure import Rules, bridges, closure
from fathomline.operators.shapes import REGISTRY_SHAPES, report

RULES = Rules(("orcid", "account"), ("near",), ("near", "within"))


def naive(triples, rules):
    facts = {t for t in triples if None not in t}
    while True:
        new = set()
        for s, p, o in facts:
            if p in rules.symmetric or p == "sameAs":
                new.add((o, p, s))
            for s2, p2, o2 in facts:
                if p == p2 and o == s2 and (p in rules.transitive or p == "sameAs"):
                    new.add((s, p, o2))
                if p == p2 and p in rules.inverse_functional and o == o2 and s != s2:
                    new.add((s, "sameAs", s2))
                if p == "sameAs" and p2 != "sameAs" and s == s2:
                    new.add((o, p2, o2))
                if p == "sameAs" and p2 != "sameAs" and s == o2:
                    new.add((s2, p2, o))
        if new <= facts:
            return facts
        facts |= new


def test_closure_is_the_naive_one(table):
    rnd = random.Random(4)
    for k in range(3):
        node = lambda: f"n{rnd.randrange(14)}"
        rows = [(node(), rnd.choice(["near", "within", "account", "likes"]), node()) for _ in range(9)] + [(node(), "orcid", f"v{rnd.randrange(9)}") for _ in range(6)]
        rows += [("n0", "sameAs", "n1"), (None, "orcid", "v1"), rows[0]] if k else [(None, "near", "x")]
        classes, facts = closure(table(rows, "s string, p string, o string"), RULES)
        all_ = naive(rows, RULES)
        same = {r.node: r.same for r in classes.collect()}
        least = {}
        for s, p, o in all_:
            if p == "sameAs":
                least[s] = min(least.get(s, s), s, o)
        assert {n: c for n, c in same.items() if n != c} == {n: c for n, c in least.items() if n != c}
        root = lambda x: least.get(x, x)  # noqa: B023, E731
        assert {tuple(r) for r in facts.collect()} == {(root(s), p, root(o)) for s, p, o in all_ if p != "sameAs"}


def test_bridges_of_a_large_class_are_dealt(table, monkeypatch):
    for name, size in (("SIDE", 16), ("TURN", 5), ("WEIGHT", 1)):
        monkeypatch.setattr(f"fathomline.operators.closure.{name}", size, raising=False)
    rows = [(f"{kind}/{i}", "least") for kind, n in (("person", 300), ("coauthor", 90)) for i in range(n)]
    rows += [("person/a", "x"), ("coauthor/b", "x"), ("coauthor/c", "x"), ("person/lone", "y"), ("coauthor/lone", "z"), ("coauthor/none", None), *((f"person/y{i}", "y") for i in range(40))]
    kind = lambda name: F.col("node").startswith(f"{name}/")
    found = bridges(table(rows, "node string, same string").coalesce(1), kind("person"), kind("coauthor")).withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r.left, r.right) for r in found) == sorted((a, b) for a, x in rows for b, y in rows if x == y is not None and a[:6] == "person" and b[:8] == "coauthor")
    held = [sum(r["at"] == at for r in found) for at in {r["at"] for r in found}]
    assert max(held) < len(found) / 2
    assert bridges(table(rows, "node string, same string").where("same = 'y'"), kind("person"), kind("coauthor")).count() == 0


def test_bridges_and_other_rules(table):
    t = table([("person/1", "orcid", "v"), ("coauthor/9", "orcid", "v"), ("person/2", "orcid", "w")], "s string, p string, o string")
    classes, _ = closure(t, Rules(("orcid",)))
    is_ = lambda kind: F.col("node").contains(f"{kind}/")
    assert [tuple(r) for r in bridges(classes, is_("person"), is_("coauthor")).collect()] == [("person/1", "coauthor/9")]
    none, facts = closure(t, Rules())
    assert none.count() == 0 and facts.count() == 3


GOOD = {
    "RegistryPerson": {"orcidId": "0000-0002-1825-0097", "sourceUrl": "https://a.org/x", "confidence": "high", "retrievedAt": "2026-01-02"},
    "CoauthorEdge": {"edgeParticipant": ["p", "q"], "evidenceWork": "w", "coPublicationCount": "3", "matchMethod": "OrcidEquality", "sourceUrl": "https://a.org/x", "retrievedAt": "2026-01-02", "confidence": "low"},
    "CoauthorCandidate": {"openAlexAuthorId": "A1", "seenWith": "p", "decision": "pending", "sourceUrl": "https://a.org/x", "confidence": "low"},
    "ValidationResult": {"verdict": "Pass", "checkId": "c", "sourceUrl": "https://a.org/x", "retrievedAt": "2026-01-02", "confidence": "low"},
    "AreaAssignment": {"area": "area", "sourceUrl": "https://a.org/x", "confidence": "low", "areaWeight": "0.5"},
    "CohortMembership": {"cohort": "ScholarCohort", "sourceUrl": "https://a.org/x", "confidence": "low"},
}
IRIS = {"edgeParticipant", "evidenceWork", "exemplarWork", "matchMethod", "verdict", "area", "cohort", "seenWith", "type", "coauthorOf"}


def node(name, cls, **changes):
    out = [(name, "type", cls, True, None)]
    for p, values in (GOOD[cls] | changes).items():
        for v in values if isinstance(values, list) else [] if values is None else [values]:
            out.append((name, p, v, p in IRIS, None if p in IRIS else "xsd:date" if p == "retrievedAt" else "xsd:string"))
    return out


BASE = [
    *node("p", "RegistryPerson"), *node("q", "RegistryPerson"), ("p", "type", "Person", True, None), ("q", "type", "Person", True, None),
    ("area", "type", "ResearchArea", True, None), ("w", "doi", "10.1/x", False, "xsd:string"),
]


def told(table, rows):
    found = report(table(BASE + rows, "s string, p string, o string, iri boolean, datatype string"))
    return {(r.focus, r.shape, r.constraint): (r.severity, r.n) for r in found.collect()}


def test_right_nodes_give_nothing(table):
    rows = [x for cls in GOOD for x in node(f"good {cls}", cls)]
    assert told(table, [*rows, *rows, ("p", "coauthorOf", "q", True, None), (None, "tier", "bad", False, None)]) == {}


def test_each_shape_reports(table):
    rows = [
        *node("a1", "RegistryPerson", orcidId=None, sourceUrl="lto:people", confidence=["high", "odd"], retrievedAt="soon", rorId="x", tier="old"),
        *node("a2", "RegistryPerson", sourceUrl="http://b.org", orcidId=["https://orcid.org/0", "0000-0002-1825-0097"], openAlexAuthorId="5", retrievedAt=None),
        *node("e1", "CoauthorEdge", edgeParticipant=["p"], evidenceWork=None, coPublicationCount="0", matchMethod="NameSimilarity", sourceUrl="lto:people", confidence=None),
        *node("e2", "CoauthorEdge", edgeParticipant=["p", "q", "w"], evidenceWork="w2", exemplarWork=["w3", "w"], coPublicationCount="many"),
        *node("c1", "CoauthorCandidate", openAlexAuthorId=None, seenWith="w", decision="rejected"),
        *node("c2", "CoauthorCandidate", decision="deferred", disambiguationEvidence="two namesakes"),
        *node("v1", "ValidationResult", verdict="Fail", checkId=None), *node("v2", "ValidationResult", verdict="Maybe"),
        *node("s1", "AreaAssignment", area="p", areaWeight="1.5", sourceUrl=None), *node("m1", "CohortMembership", cohort="Team", confidence="sure"),
        ("p", "coauthorOf", "a1", True, None), ("p", "coauthorOf", "q", True, None), ("p", "coauthorOf", "a2", True, None),
    ]
    got = told(table, rows)
    want = {
        ("a1", "RegistryPerson", "or orcidId, openAlexAuthorId"): 1, ("a1", "RegistryPerson", "confidence maxCount"): 1, ("a1", "RegistryPerson", "confidence in"): 1,
        ("a1", "RegistryPerson", "retrievedAt datatype"): 1, ("a1", "RegistryPerson", "rorId pattern"): 1, ("a1", "RegistryPerson", "tier in"): 1,
        ("a2", "RegistryPerson", "orcidId pattern"): 1, ("a2", "RegistryPerson", "orcidId maxCount"): 1, ("a2", "RegistryPerson", "openAlexAuthorId pattern"): 1, ("a2", "RegistryPerson", "retrievedAt minCount"): 1,
        ("lto:people", "SourceUrlSpecificity", "pattern"): 1, ("http://b.org", "SourceUrlSpecificity", "pattern"): 1, ("lto:people", "InternalProvenance", "not pattern"): 1,
        ("e1", "CoauthorEdge", "edgeParticipant minCount"): 1, ("e1", "CoauthorEdge", "or evidenceWork, exemplarWork"): 1, ("e1", "CoauthorEdge", "coPublicationCount minInclusive"): 1,
        ("e1", "CoauthorEdge", "matchMethod in"): 1, ("e1", "CoauthorEdge", "sourceUrl pattern"): 1, ("e1", "CoauthorEdge", "confidence minCount"): 1,
        ("e2", "CoauthorEdge", "edgeParticipant maxCount"): 1, ("e2", "CoauthorEdge", "edgeParticipant class"): 1, ("e2", "CoauthorEdge", "exemplarWork maxCount"): 1, ("e2", "CoauthorEdge", "coPublicationCount minInclusive"): 1,
        ("w2", "EvidenceWork", "or openAlexWorkId, doi"): 1, ("w3", "ExemplarWork", "or openAlexWorkId, doi"): 1, ("p", "CoauthorShortcut", "coauthorOf backed by CoauthorEdge"): 2,
        ("c1", "CoauthorCandidate", "or orcidId, openAlexAuthorId"): 1, ("c1", "CoauthorCandidate", "seenWith class"): 1, ("c1", "CoauthorCandidate", "decision needs disambiguationEvidence"): 1,
        ("v1", "ValidationResult", "verdict needs mismatchDetail"): 1, ("v1", "ValidationResult", "checkId minCount"): 1, ("v2", "ValidationResult", "verdict in"): 1,
        ("s1", "AreaAssignment", "area class"): 1, ("s1", "AreaAssignment", "areaWeight maxInclusive"): 1, ("s1", "AreaAssignment", "sourceUrl minCount"): 1,
        ("m1", "CohortMembership", "cohort in"): 1, ("m1", "CohortMembership", "confidence in"): 1,
    }
    assert {k: n for k, (_, n) in got.items()} == want
    assert {k[1] for k in got} == {s.name for s in REGISTRY_SHAPES} and got["lto:people", "InternalProvenance", "not pattern"][0] == "Warning"


def test_rounds_build_on_tables_read_anew(table):
    from fathomline.operators import graph

    edges = table([(i, i + 1) for i in range(20)], "a long, b long")
    assert graph.components(edges).inputFiles()
    classes, _ = closure(table([("x", "id", "1"), ("y", "id", "1")], "s string, p string, o string"), Rules(inverse_functional=("id",)))
    assert classes.inputFiles() and {tuple(r) for r in classes.collect()} == {("x", "x"), ("y", "x")}


def test_triples_are_dealt_by_their_number(table, monkeypatch):
    from fathomline.operators import metrics

    monkeypatch.setattr(metrics, "TASK_ROWS", 2)
    rows = [*node("both", "RegistryPerson", sourceUrl=None), *node("both", "CohortMembership", sourceUrl=None, cohort=None), ("bare", "type", "ResearchArea", True, None), ("bare", "type", "CoauthorEdge", True, None)]
    found = report(table(BASE + rows, "s string, p string, o string, iri boolean, datatype string"))
    got = {(r.focus, r.shape, r.constraint) for r in found.collect()}
    assert got >= {("both", "RegistryPerson", "sourceUrl minCount"), ("both", "CohortMembership", "sourceUrl minCount"), ("both", "CohortMembership", "cohort minCount"), ("bare", "CoauthorEdge", "matchMethod minCount")}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() and "hashpartitioning(s" in found._jdf.queryExecution().toString()
