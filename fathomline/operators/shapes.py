"""Shapes of nodes: constraints as data, checked in one aggregation over the triples of all classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.metrics import dealt


@dataclass(frozen=True)
class Property:
    """What the values of one property must be. Every failing value counts; the number of values counts once."""

    path: str
    least: int = 0
    most: int | None = None
    pattern: str | None = None
    values: tuple[str, ...] | None = None
    iris: bool = False
    datatype: str | None = None
    literal: bool = False
    low: float | None = None
    high: float | None = None
    of: str | None = None


@dataclass(frozen=True)
class Shape:
    """Constraints on the nodes of a class (``cls``), or on the objects or subjects of a property."""

    name: str
    cls: str | None = None
    objects_of: str | None = None
    properties: tuple[Property, ...] = ()
    any_of: tuple[str, ...] = ()
    pattern: str | None = None
    not_pattern: str | None = None
    #: (property, its values, property that must then be there)
    when: tuple[str, tuple[str, ...], str] | None = None
    #: (property, class, participant): each s-property-o needs a node of the class that names both as participants
    backed: tuple[str, str, str] | None = None
    severity: str = field(default="Violation")


_URL, _CONFIDENCE = r"^https?://[^\s]+$", ("high", "medium", "low")
_DATE, _TEXT = "xsd:date", "xsd:string"
#: Classes, properties, patterns and vocabularies of the registry's shapes.
REGISTRY_SHAPES = (
    Shape("RegistryPerson", "RegistryPerson", any_of=("orcidId", "openAlexAuthorId"), properties=(
        Property("sourceUrl", 1, 1, r"^(https?://[^\s]+|lto:[a-z_]+)$"), Property("confidence", 1, 1, values=_CONFIDENCE, datatype=_TEXT),
        Property("retrievedAt", 1, 1, datatype=_DATE), Property("orcidId", most=1, pattern="^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"),
        Property("openAlexAuthorId", most=1, pattern="^A[0-9]+$"), Property("rorId", most=1, pattern=r"^(https://ror\.org/)?0[0-9a-hjkmnp-z]{6}[0-9]{2}$"),
        Property("tier", most=1, values=("core", "archive")))),
    Shape("SourceUrlSpecificity", objects_of="sourceUrl", pattern="^https?://[^/]+/.+", severity="Warning"),
    Shape("InternalProvenance", objects_of="sourceUrl", not_pattern="^lto:", severity="Warning"),
    Shape("CoauthorEdge", "CoauthorEdge", any_of=("evidenceWork", "exemplarWork"), properties=(
        Property("edgeParticipant", 2, 2, of="Person"), Property("coPublicationCount", 1, 1, literal=True, low=1),
        Property("matchMethod", 1, 1, values=("OrcidEquality", "OpenAlexAuthorIdEquality", "SameAsClosure"), iris=True), Property("sourceUrl", 1, pattern=_URL),
        Property("retrievedAt", 1, datatype=_DATE), Property("confidence", 1, 1, values=_CONFIDENCE), Property("exemplarWork", most=1))),
    Shape("EvidenceWork", objects_of="evidenceWork", any_of=("openAlexWorkId", "doi")),
    Shape("ExemplarWork", objects_of="exemplarWork", any_of=("openAlexWorkId", "doi")),
    Shape("CoauthorShortcut", backed=("coauthorOf", "CoauthorEdge", "edgeParticipant")),
    Shape("CoauthorCandidate", "CoauthorCandidate", any_of=("orcidId", "openAlexAuthorId"), properties=(
        Property("seenWith", 1, of="RegistryPerson"), Property("decision", 1, 1, values=("pending", "accepted", "rejected", "deferred")),
        Property("sourceUrl", 1, pattern=_URL), Property("confidence", 1, values=_CONFIDENCE)), when=("decision", ("rejected", "deferred"), "disambiguationEvidence")),
    Shape("ValidationResult", "ValidationResult", properties=(
        Property("verdict", 1, 1, values=("Pass", "Fail", "NotApplicable", "Unresolved"), iris=True), Property("checkId", 1, 1, datatype=_TEXT), Property("sourceUrl", 1, pattern=_URL),
        Property("retrievedAt", 1, datatype=_DATE), Property("confidence", 1, values=_CONFIDENCE)), when=("verdict", ("Fail",), "mismatchDetail")),
    Shape("AreaAssignment", "AreaAssignment", properties=(
        Property("area", 1, 1, of="ResearchArea"), Property("areaWeight", most=1, literal=True, low=0.0, high=1.0), Property("sourceUrl", 1), Property("confidence", 1, values=_CONFIDENCE))),
    Shape("CohortMembership", "CohortMembership", properties=(
        Property("cohort", 1, 1, values=("SitePersonnelCohort", "ScholarCohort"), iris=True), Property("sourceUrl", 1), Property("confidence", 1, values=_CONFIDENCE))),
)


def _value_checks(x: Property) -> list[tuple[str, Column]]:
    """(name, condition for a value that fails)."""
    o, out = F.col("o"), []
    if x.pattern:
        out.append(("pattern", ~o.rlike(x.pattern)))
    if x.values is not None:
        out.append(("in", ~o.isin(*x.values) | (F.col("iri") != x.iris)))
    if x.datatype:
        wrong = F.col("iri") | ~F.coalesce(F.col("datatype") == x.datatype, F.lit(False))
        out.append(("datatype", wrong | o.try_cast("date").isNull() if x.datatype == _DATE else wrong))
    if x.literal:
        out.append(("nodeKind", F.col("iri")))
    number = o.try_cast("double")
    if x.low is not None:
        out.append(("minInclusive", ~F.coalesce(~F.col("iri") & (number >= x.low), F.lit(False))))
    if x.high is not None:
        out.append(("maxInclusive", ~F.coalesce(~F.col("iri") & (number <= x.high), F.lit(False))))
    if x.of:
        out.append(("class", ~F.coalesce(F.array_contains("kinds", x.of), F.lit(False))))
    return out


def _of_classes(triples: DataFrame, types: DataFrame, shapes: Sequence[Shape], type_path: str) -> DataFrame | None:
    """What fails in all shapes of classes, from one pass over the triples.

    A triple gives the numbers of what it counts for (its property, and the checks that its value fails), looked up by its property, so it
    costs the checks of that property only; numbers are counted by node, and a node is judged by the counts it has. Classes of a node are such numbers too.
    """
    own = [s for s in shapes if s.cls]
    if not own:
        return None
    codes: dict[str, dict[object, tuple[int, Column | None]]] = {}
    judged: dict[str, list[Column]] = {}

    def count(path: str, what: object = None, bad: Column | None = None) -> Column:
        """How many triples of the property a node has, or how many of them are bad."""
        here = codes.setdefault(path, {})
        if what not in here:
            here[what] = sum(map(len, codes.values())), bad
        return F.coalesce(F.try_element_at("counts", F.lit(here[what][0])), F.lit(0).cast("long"))

    for shape in own:
        def put(name: str, failed: Column, n: Column | int = 1, shape=shape) -> None:
            judged.setdefault(shape.cls, []).append(F.when(failed, F.struct(
                F.lit(shape.name).alias("shape"), F.lit(name).alias("constraint"), F.lit(shape.severity).alias("severity"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("n"))))

        for x in shape.properties:
            if x.least:
                put(f"{x.path} minCount", count(x.path) < x.least)
            if x.most is not None:
                put(f"{x.path} maxCount", count(x.path) > x.most)
            for kind, bad in _value_checks(x):
                n = count(x.path, (shape.name, x, kind), bad)
                put(f"{x.path} {kind}", n > 0, n)
        if shape.any_of:
            put("or " + ", ".join(shape.any_of), F.greatest(F.lit(0).cast("long"), *(count(path) for path in shape.any_of)) == 0)
        if shape.when:
            path, values, needs = shape.when
            put(f"{path} needs {needs}", (count(path, (shape.name, shape.when), F.col("o").isin(*values)) > 0) & (count(needs) == 0))
    for cls in judged:
        count(type_path, ("class", cls), F.col("o") == cls)
    # in a lambda, since the code for all properties would make a method that Java does not compile
    each = {path: F.array_compact(F.array(*(F.lit(i) if bad is None else F.when(bad, F.lit(i)) for i, bad in here.values()))) for path, here in codes.items()}
    code = F.get(F.transform(F.array("p"), lambda p: F.coalesce(*(F.when(p == path, then) for path, then in each.items()))), 0)
    asked = {p.path for s in own for p in s.properties if p.of}
    kinds = types.groupBy(F.col("node").alias("__n")).agg(F.collect_set("cls").alias("kinds"))
    given = dealt(triples.where(F.col("p").isin(*codes)), "s").distinct()
    plain = given.where(~F.col("p").isin(*asked)).withColumn("kinds", F.lit(None).cast("array<string>"))
    rows = plain if not asked else given.where(F.col("p").isin(*asked)).join(kinds, F.col("o") == F.col("__n"), "left").select(*plain.columns).unionByName(plain)
    met = rows.select(F.col("s").alias("focus"), F.explode(code).alias("code"))
    counts = met.groupBy("focus", "code").agg(F.count("*").alias("n")).groupBy("focus").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("counts"))
    fails = F.flatten(F.array(*(F.when(count(type_path, ("class", cls)) > 0, F.array_compact(F.array(*of))).otherwise(F.array()) for cls, of in judged.items())))
    return counts.select("focus", F.explode(fails).alias("x")).select("focus", "x.*")


def _of_objects(triples: DataFrame, shapes: Sequence[Shape]) -> DataFrame | None:
    """Shapes of the objects of properties: their text, or what they carry themselves."""
    own, out = [s for s in shapes if s.objects_of], None
    for shape in own:
        focus = triples.where(F.col("p") == shape.objects_of).select(F.col("o").alias("focus")).distinct()
        for name, bad in (("pattern", ~F.col("focus").rlike(shape.pattern or "")), ("not pattern", F.col("focus").rlike(shape.not_pattern or ""))):
            if shape.pattern and name == "pattern" or shape.not_pattern and name == "not pattern":
                found = focus.where(bad).select("focus", F.lit(name).alias("constraint"))
                out = _with(out, found, shape)
        if shape.any_of:
            held = triples.where(F.col("p").isin(*shape.any_of)).select(F.col("s").alias("focus"))
            out = _with(out, focus.join(held, "focus", "left_anti").select("focus", F.lit("or " + ", ".join(shape.any_of)).alias("constraint")), shape)
    return out


def _with(out: DataFrame | None, found: DataFrame, shape: Shape) -> DataFrame:
    if "n" not in found.columns:
        found = found.withColumn("n", F.lit(1).cast("long"))
    rows = found.select("focus", F.lit(shape.name).alias("shape"), "constraint", F.lit(shape.severity).alias("severity"), "n")
    return rows if out is None else out.unionByName(rows)


def _backed(triples: DataFrame, types: DataFrame, shapes: Sequence[Shape]) -> DataFrame | None:
    """Shortcuts between two nodes without a node of the class that names both."""
    out = None
    for shape in (s for s in shapes if s.backed):
        path, cls, part = shape.backed
        nodes = types.where(F.col("cls") == cls).select("node")
        ends = triples.where(F.col("p") == part).join(nodes, F.col("s") == F.col("node")).select("node", "o").distinct()
        both = ends.join(ends.select("node", F.col("o").alias("other")), "node").select(F.col("o").alias("s"), F.col("other").alias("o")).distinct()
        alone = triples.where(F.col("p") == path).select("s", "o").distinct().join(both, ["s", "o"], "left_anti")
        found = alone.groupBy(F.col("s").alias("focus")).agg(F.count("*").alias("n")).withColumn("constraint", F.lit(f"{path} backed by {cls}"))
        out = _with(out, found, shape)
    return out


def report(triples: DataFrame, shapes: Sequence[Shape] = REGISTRY_SHAPES, type_path: str = "type") -> DataFrame:
    """(focus, shape, constraint, severity, n) for triples (s, p, o, iri, datatype): n values of the focus fail the constraint, or 1 for
    constraints on their number.

    Repeated triples count once; triples with a null end are left out; a node of several classes is held against each. An empty table
    gives no rows. Classes share one aggregation over the triples; only properties with a required class look up their objects, and
    only shortcuts are joined with the pairs of each backing node (two, where that node is right itself).
    """
    given = triples.select("s", "p", "o", F.coalesce("iri", F.lit(False)).alias("iri"), "datatype").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    types = given.where(F.col("p") == type_path).select(F.col("s").alias("node"), F.col("o").alias("cls")).distinct()
    found = [x for x in (_of_classes(given, types, shapes, type_path), _of_objects(given, shapes), _backed(given, types, shapes)) if x is not None]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
