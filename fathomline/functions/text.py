"""Text, identifier, url and date expressions of built-in functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def short_key(*parts: str | Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-1 of lower-cased parts joined by a bar; null parts are empty."""
    cols = [F.lower(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit(""))) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *cols)), 1, length)


def slug(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(StringType())
def unaccented(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def folded(text: str | Column) -> Column:
    """Lower case without accents and outer spaces."""
    return F.trim(F.lower(unaccented(text)))


#: Long unit names and what stands for them in comparisons.
UNIT_NAMES = (
    ("national wildlife refuge", "nwr"), ("national monument", "nm"), ("national park", "np"), ("national seashore", "nashore"),
    ("national lakeshore", "nlshore"), ("national preserve", "npreserve"), ("national recreation area", "nra"),
)
#: Acronyms and the words that they stand for.
ACRONYMS = (
    ("nerr", "national estuarine research reserve"), ("nms", "national marine sanctuary"), ("nep", "national estuary program"),
    ("ltreb", "long term research environmental biology"), ("lter", "long term ecological research"), ("nps", "national park service"),
    ("noaa", "national oceanic atmospheric administration"), ("ucsb", "university california santa barbara"), ("usf", "university south florida"),
    ("ucsd", "university california san diego"), ("uw", "university washington"), ("dfo", "fisheries oceans canada"),
)
#: Words that an organisation's name is compared without.
CONNECTORS = (
    "the", "a", "an", "of", "and", "for", "at", "in", "on", "institute", "foundation", "incorporated", "inc", "llc", "department", "reserve", "sanctuary",
)
#: Words that tell nothing about which organisation it is.
GENERIC_WORDS = (
    "national", "international", "state", "federal", "center", "centre", "research", "science", "sciences", "scientific", "laboratory", "lab",
    "laboratories", "university", "universidad", "universite", "college", "school", "program", "programme", "project", "service", "services",
    "agency", "office", "bureau", "division", "unit", "group", "society", "association", "council", "committee", "commission", "authority",
    "organization", "organisation", "corporation", "company", "trust", "network", "consortium", "partnership", "alliance", "system",
    "systems", "studies", "study", "environmental", "environment", "natural", "resources", "management", "development", "technology",
    "technologies", "engineering", "academy", "museum", "long", "term", "ecological", "estuarine",
)


def plain_name(text: str | Column) -> Column:
    """Lower case with short forms of unit names; a null is an empty name."""
    c = F.lower(F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))
    for long, short in UNIT_NAMES:
        c = F.replace(c, F.lit(long), F.lit(short))
    return c


def organisation(text: str | Column) -> Column:
    """A name for comparison: folded, dashes as spaces, acronyms written out, without connectors."""
    c = F.translate(folded(text), "—–-", "   ")
    for short, long in ACRONYMS:
        c = F.regexp_replace(c, rf"(?U)\b{short}\b", long)
    return F.array_join(F.filter(F.split(c, r"\s+"), lambda t: (t != "") & ~t.isin(*CONNECTORS)), " ")


#: Further words that tell nothing about which site it is.
GENERIC_SITE_WORDS = ("experimental", "forest", "range", "station", "field", "observatory", "monitoring", "watershed")


def distinctive_tokens(text: str | Column, generic: Sequence[str] = GENERIC_WORDS) -> Column:
    """The distinct words of three letters or more of a name for comparison that generic names don't share."""
    return distinctive(organisation(text), generic)


def distinctive(compared: Column, generic: Sequence[str] = GENERIC_WORDS) -> Column:
    """As distinctive_tokens, from a name that is ready for comparison; in the order of the name."""
    return F.array_distinct(F.filter(F.split(compared, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*generic)))


def orcid(text: str) -> Column:
    """An ORCID in a text or url, else null."""
    return F.nullif(F.regexp_extract(F.upper(text), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1), F.lit(""))


def last_segment(text: str) -> Column:
    return F.substring_index(F.regexp_replace(text, "/+$", ""), "/", -1)


def bare_url(url: str) -> Column:
    """Without scheme, www. and trailing slash, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(url))), r"^https?://(www\.)?", ""), "/+$", "")


def host(url: str) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)


def apex_domain(url: str) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def rewritten(text: str, rules: Sequence[tuple[str, str | None]]) -> Column:
    """The first rule whose pattern is found rewrites the text, or makes it null; else unchanged."""
    c = F.col(text)
    out = None
    for pattern, new in rules:
        made = F.lit(None).cast("string") if new is None else F.regexp_replace(c, pattern, new)
        out = F.when(c.rlike(pattern), made) if out is None else out.when(c.rlike(pattern), made)
    return out.otherwise(c)


def fiscal_year(date: str | Column) -> Column:
    """The US federal fiscal year: October starts the next one."""
    c = F.col(date) if isinstance(date, str) else date
    return (F.year(c) + F.when(F.month(c) >= 10, 1).otherwise(0)).cast("int")


def us_date(text: str) -> Column:
    """M/D/YYYY as a date; anything else is null."""
    return F.try_to_timestamp(F.col(text), F.lit("M/d/yyyy")).cast("date")


def yearly_amounts(text: str) -> Column:
    """(fiscal_year, amount) structs of a text like ``FY 2019 = $1,234.50``; the dollar sign may be absent.

    What isn't a year, a sign of equality and a plain amount is passed over: ``FY 2018 $5``, ``the FY report``, ``FY 2019=$1.2.3``.
    """
    # each part after an "FY" starts with its year; what follows the sign of equality is the amount
    parts = F.slice(F.split(F.col(text), "FY"), 2, 1 << 30)
    said = lambda x: F.translate(F.regexp_substr(F.ltrim(F.translate(F.get(F.split(x, "="), F.lit(1)), "$", " ")), F.lit(r"^[0-9][0-9,.]*")), ",", "")
    named = F.transform(parts, lambda x: F.struct(
        F.try_to_number(F.regexp_extract(F.trim(F.substring_index(x, "=", 1)), "^([0-9]{4})$", 1), F.lit("9999")).cast("int").alias("fiscal_year"),
        F.rtrim(said(x), F.lit(".")).try_cast("double").alias("amount")))
    return F.filter(named, lambda v: v["fiscal_year"].isNotNull() & v["amount"].isNotNull())


def dms(text: str) -> Column:
    """The first angle of a text as decimal degrees: see angles."""
    return F.get(angles(text), 0)


def angles(text: str) -> Column:
    """All angles of a text, as decimal degrees: one to three numbers (degrees, minutes, seconds, each may have decimals after
    a point or comma) and a compass letter, or one such letter and then the numbers; south and west are negative.

    A letter belongs to the numbers on the side that the text's first angle shows. Forms that aren't read give nothing: more than
    three numbers, minutes or seconds of 60 and more, degrees over 180 (90 with N and S).
    """
    number, gap = r"[0-9]+(?:[.,][0-9]+)?", r"[^0-9A-Z]*"
    several = rf"{number}(?:{gap}{number}){{0,9}}"
    c = F.upper(text)
    after, before = rf"(?<![0-9.,])({several}{gap}[NSEW](?![A-Z]))", rf"((?<![A-Z])[NSEW]{gap}{several})"
    leads = F.coalesce(F.regexp_extract(c, rf"^[^0-9]*?((?<![A-Z])[NSEW]){gap}[0-9]", 1) != "", F.lit(False))
    found = F.when(leads, F.regexp_extract_all(c, F.lit(before), 1)).otherwise(F.regexp_extract_all(c, F.lit(after), 1))

    def value(one: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(one, F.lit(f"({number})"), 1), lambda n: F.translate(n, ",", ".").try_cast("double"))
        part = lambda i: F.coalesce(F.get(numbers, F.lit(i)), F.lit(0.0))
        size = part(0) + part(1) / 60 + part(2) / 3600
        letter = F.regexp_extract(one, "([NSEW])", 1)
        whole = (F.size(numbers) <= 3) & (part(1) < 60) & (part(2) < 60) & (size <= F.when(letter.isin("N", "S"), 90).otherwise(180))
        return F.when(whole, F.when(letter.isin("S", "W"), -size).otherwise(size))

    return F.filter(F.transform(found, value), lambda v: v.isNotNull())


def given_names_agree(a: Column, b: Column) -> Column:
    """Given names agree token by token, an initial agreeing with any name it starts."""
    x, y = (F.filter(F.split(F.lower(c), r"[\s.\-]+"), lambda t: t != "") for c in (a, b))
    pairs = F.zip_with(x, y, lambda p, q: p.isNull() | q.isNull() | (p == q) | (F.length(p) == 1) & F.startswith(q, p) | (F.length(q) == 1) & F.startswith(p, q))
    return (F.size(x) > 0) & (F.size(y) > 0) & F.forall(pairs, lambda v: v)
