"""Main text of web pages by differencing with the page of the nearest URL, with structure beside it.

A page is cut into lines (blocks of text). Lines in elements for menus, headers, footers, sidebars,
notices, adverts, forms, scripts or reader comments go. Within each host the pages are put in order
of URL path, and each is paired with the page before or after it, whichever shares the longer
start of the path. The lines of both are aligned by longest common subsequence, and lines that both share go: what
pages of a host repeat is their frame. Lines of an ``article`` or ``main`` are the text by contract, so there only
lines of elements whose names hint at a frame, and no more than hint, depend on the neighbour; a page with an
``article`` or ``main`` has no other text.

Pages of equal lines on one host are copies and tell nothing about the frame: they stand in the order once, so each
is paired with a page of other lines. Pages without lines are left out of the order. A page's text depends on the
pages of its host alone and not on their layout in partitions.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows, small, written

# Element names of HTML.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr mi mn mo ms mtext mrow msup msub mfrac msqrt semantics".split()
)
SKIPPED = frozenset(
    "script style textarea title iframe noembed noframes noscript template head nav footer aside form menu "
    "button select option datalist dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that stand for a frame.
FRAME = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login sidebar side widget widgets "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond replies reply "
    "share sharing social related recommended recommendations footer masthead toolbar search skip teaser disclaimer".split()
)
#: Such words that an anchor of a section is hardly named by.
FRAME_ID = FRAME - frozenset("promotion notice alert side widget widgets menu share sharing social related recommended search skip disclaimer subscription reply".split())
HEAD = frozenset("header topbar".split())
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset(
    "box block container wrapper wrap section list links link item items inner outer content bar button buttons post page site top bottom "
    "left right main area message group panel primary secondary global form text unit slot zone icons icon media col row article entry posts articles stories pages entries".split()
)
NOT_BY_NAME = frozenset("html body main".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
INSIDE = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")

FREE, IN_MAIN, IN_ARTICLE = 0, 1, 2
PLAIN, HINTED, FRAMED = 0, 1, 2


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())


def _kind(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element belongs to the frame of a page, by its name, or may do so, by a word of its names."""
    if name in SKIPPED or (name == "header" and not in_article):
        return FRAMED
    if not attributes.strip() or name in NOT_BY_NAME:
        return PLAIN
    held: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        held.setdefault(k.lower(), html.unescape(a or b or c or ""))
    if "hidden" in held or held.get("aria-hidden", "").lower() == "true" or "display:none" in held.get("style", "").replace(" ", "").lower():
        return FRAMED
    if held.get("role", "").lower() in ROLES:
        return FRAMED
    if name == "article" and not in_article:
        return PLAIN
    found = PLAIN
    for key, strong in (("class", FRAME), ("id", FRAME_ID)):
        words = set(_words(held.get(key, "")))
        frame = FRAME if in_article else FRAME | HEAD
        if words & frame:
            only = words <= frame | NEUTRAL and bool(words & (strong if in_article else strong | HEAD))
            found = max(found, FRAMED if only and name not in HEADINGS else HINTED)
    return found


def _tag(page: str, at: int, last: int) -> tuple[int, int, str, bool, str] | None:
    """The next piece of markup from ``at``: start, end, element name, whether it ends the element, attributes.

    Comments and the like have no name. Each part of the page is passed once; ``last`` is the place of the last ``>``.
    Markup that the page's end cuts off reaches to that end.
    """
    size = len(page)
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            return i, end + 3 if end >= 0 else size, "", False, ""
        if page.startswith("<![CDATA[", i):
            end = page.find("]]>", i + 9)
            return i, end + 3 if end >= 0 else size, "![CDATA[", False, page[i + 9 : end if end >= 0 else size]
        if page[i + 1 : i + 2] in ("!", "?"):
            return i, page.find(">", i) + 1 if i <= last else size, "", False, ""
        if m := NAME.match(page, i):
            inside = INSIDE.match(page, m.end())  # else a quote that nothing closes
            end = inside.end() if inside else page.find(">", m.end()) + 1 if m.end() <= last else size
            cut = inside is None and m.end() > last
            return i, end, m[1].lower(), page[i + 1] == "/", page[m.end() : end if cut else end - 1]
        at = i + 1
    return None


def lines(page: str | None) -> list[tuple[str, int, int]]:
    """(text, where it stands, whether a name hints at a frame) for each line outside the frame."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # name, kind, place
    open_names: Counter = Counter()
    parts: list[str] = []
    page = page or ""
    at, last = 0, page.rfind(">")
    kind, place = PLAIN, FREE

    def close():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, place, kind))
            parts.clear()

    def drop(k: int):
        nonlocal kind, place
        for name, _, _ in stack[k:]:
            open_names[name] -= 1
        del stack[k:]
        kind, place = stack[-1][1:] if stack else (PLAIN, FREE)

    while at < len(page):
        found = _tag(page, at, last)
        start, end, name, ends, attributes = found or (len(page), len(page), "", False, "")
        if start > at and kind != FRAMED:
            parts.append(page[at:start])
        if found is None:
            break
        at = end
        if not name:
            continue
        if name == "![CDATA[":
            if kind != FRAMED:
                parts.append(html.escape(attributes))
            continue
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        if ends:
            if open_names[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close_before = name in INLINE and stack[k][1] != (stack[k - 1][1] if k else PLAIN)
                if close_before:
                    close()
                drop(k)
            continue
        if attributes.endswith("/") and name not in RAW:
            continue
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "xmp" and kind != FRAMED:
                parts.append(html.escape(page[at : m.start() if m else len(page)]))
                close()
            at = m.end() if m else len(page)
            continue
        if name in INLINE and not attributes.strip():
            continue
        if name not in INLINE:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and (stack[k][0] == "p" or name in CLOSED_BY.get(stack[k][0], ())):
                drop(k)
            if name == "body" and open_names["head"]:
                drop(next(k for k, x in enumerate(stack) if x[0] == "head"))
        now = max(kind, _kind(name, attributes, place == IN_ARTICLE))
        if now != kind:
            close()
        kind = now
        place = max(place, IN_ARTICLE if name == "article" else IN_MAIN if name == "main" else FREE)
        stack.append((name, kind, place))
        open_names[name] += 1
    close()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    found, link = set(), chains[-1] if chains else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def candidates(own: list[tuple[str, int, int]]) -> list[tuple[int, bool]]:
    """(number of a line, whether it goes if the neighbour has it): of an article or main where there is one, else of the page."""
    inside = any(x[1] != FREE for x in own)
    return [(k, not inside or hint == HINTED) for k, (_, place, hint) in enumerate(own) if not inside or place != FREE]


def main_text(own: list[tuple[str, int, int]], other: list[tuple[str, int, int]] | None) -> str:
    """The text of a page beside its neighbour's lines."""
    return _differenced(candidates(own), [x[0] for x in own], [x[0] for x in other or []])


def _differenced(kept: list[tuple[int, bool]], own: list[str], other: list[str]) -> str:
    gone = shared(own, other) if other and any(x[1] for x in kept) else set()
    return " ".join(own[k] for k, is_open in kept if not (is_open and k in gone))


def _same_start(a: str, b: str) -> Column:
    """Characters at the start of both, -1 where one is null."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    ends = F.array_position(F.concat(pairs, F.array(F.lit(False))), F.lit(False)) - 1
    return F.coalesce(ends, F.lit(-1))


def neighbours(parsed: DataFrame) -> DataFrame:
    """(host, told, other): for each different set of lines of a host that of the page nearest by path.

    Rows are dealt by ranges of (host, path), so a host of any size is spread; the ends of ranges are handed to
    the next ones.
    """
    order = ("host", "path", "page_id", "told")
    reps = parsed.where("told IS NOT NULL").groupBy("host", "told").agg(F.min(F.struct("path", "page_id")).alias("r")).select("host", "r.path", "r.page_id", "told")
    placed = written(reps.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "places")
    row = F.struct(*order)
    inside, across = Window.partitionBy("part").orderBy(*order), Window.orderBy("part")
    ends = placed.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last")).select(  # a row for each partition
        F.col("part").alias("p"), F.lag("last").over(across).alias("from"), F.lead("first").over(across).alias("to"))
    beside = placed.withColumn("before", F.lag(row).over(inside)).withColumn("after", F.lead(row).over(inside)).join(ends, F.col("part") == F.col("p")).select(
        *order, F.coalesce("before", "from").alias("before"), F.coalesce("after", "to").alias("after"))
    near = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), _same_start("path", f"{side}.path")).otherwise(-1)
    return beside.withColumn("a", near("before")).withColumn("b", near("after")).where("a >= 0 OR b >= 0").select(
        F.col("host").alias("h"), F.col("told").alias("t"), F.expr("if(a >= b, before.told, after.told)").alias("other"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html gives an empty text. Pages without a url form a host of their own.
    Repeated rows and null ids keep their rows. Markup that the page's end cuts off is dropped. An empty table gives no
    rows; other columns are ignored.
    """
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/+$", "")
    rows = pages.select(
        F.col("page_id").cast("long"), "url", "html",
        F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), F.lit("")).alias("path"),
    )

    def parse(batches):
        for b in batches:
            read = [lines(x) for x in b["html"]]
            kept = [candidates(x) for x in read]
            told = [hashlib.sha256("\n".join(sorted({x[0] for x in own})).encode("utf-8", "replace")).digest()[:16] if own else None for own in read]
            yield {k: b[k] for k in ("page_id", "url", "host", "path")} | {
                "told": told, "lines": [[x[0] for x in own] for own in read],
                "kept": [[x[0] for x in own] for own in kept], "open": [[x[1] for x in own] for own in kept],
                "asks": [any(x[1] for x in own) for own in kept],
            }

    columns = "page_id long, url string, host string, path string, told binary, lines array<string>, kept array<int>, open array<boolean>, asks boolean"
    parsed = written(arrow_rows(rows, columns, parse), "lines", compression="zstd")
    sure = parsed.where("NOT asks").select("page_id", "url", F.concat_ws(" ", F.transform("kept", lambda k: F.get("lines", k))).alias("text"))

    def difference(batches):
        for b in batches:
            yield {"page_id": b["page_id"], "url": b["url"], "text": [
                _differenced(list(zip(kept, flags, strict=True)), own, other or [])
                for kept, flags, own, other in zip(b["kept"], b["open"], b["lines"], b["beside"], strict=True)
            ]}

    near = neighbours(parsed)
    asking = parsed.where("asks").join(near, (F.col("host") == F.col("h")) & (F.col("told") == F.col("t")), "left").drop("h", "t")
    wanted = written(asking.select(F.col("host").alias("h"), F.col("other").alias("t")).where("t IS NOT NULL").distinct(), "beside")
    given = parsed.join(small(wanted), (F.col("host") == F.col("h")) & (F.col("told") == F.col("t")), "left_semi").select("host", "told", "page_id", "path", "lines")
    given = given.groupBy(F.col("host").alias("h"), F.col("told").alias("t")).agg(F.min_by("lines", F.struct("path", "page_id", "lines")).alias("beside"))
    beside = asking.join(given, (F.col("host") == F.col("h")) & (F.col("other") == F.col("t")), "left").select("page_id", "url", "kept", "open", "lines", "beside")
    open_pages = arrow_rows(beside, "page_id long, url string, text string", difference)
    return sure.unionByName(open_pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_pages(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
