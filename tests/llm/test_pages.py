"""Differencing of pages, and structure beside it."""

import os
import random

from fathomline.llm import pages


def test_copies_and_short_texts_lose_their_frame(spark):
    frame = "".join(f"<div>Frame line {k}</div>" for k in range(20))
    page = lambda t: f"{frame}<p>{t}</p><div>All rights</div>"
    texts = ["own a", "own a", "own a", "own b", "own c", "own c"]
    rows = [(i, f"http://h.org/a/{i}", page(t)) for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == dict(enumerate(texts))


def test_links_that_no_neighbour_repeats_stay(spark):
    rows = [(i, f"http://h.org/a/{i}", f"<div>Site name</div><p>text {i}</p><p><a href='x'>reading list {i}</a></p>") for i in range(2)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i} reading list {i}" for i in range(2)}


def slow_text(rows):
    """Each page beside the page nearest by path of its host, found by looking at all of them."""
    read = {k: pages.lines(source) for k, _, source in rows}
    spot = {}
    for k, url, _ in rows:
        rest = (url or "").split("://", 1)[-1].split("?")[0].split("#")[0].rstrip("/")
        spot[k] = (rest.partition("/")[0].lower(), "/" + rest.partition("/")[2] if "/" in rest else "")
    told = {k: frozenset(x[0] for x in read[k]) for k in read}
    out = {}
    for k in read:
        first = {}
        for j in sorted(read, key=lambda j: (spot[j][1], j)):
            if told[j] and spot[j][0] == spot[k][0]:
                first.setdefault(told[j], j)
        order = list(first.values())
        other = None
        if told[k]:
            at = order.index(first[told[k]])
            alike = lambda j: len(os.path.commonprefix([spot[j][1], spot[order[at]][1]]))
            near = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
            other = max(near, key=alike) if near else None
        out[k] = pages.main_text(read[k], read[other] if other is not None else None)
    return out


def test_extraction_is_brute_force_in_any_layout(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(160):
        host = rnd.choice(["a.org", "b.org", "b.org"])
        parts = [f"<div>{rnd.choice(['Site', 'Shop', 'News'])}</div>"] + [f"<p>line {rnd.randint(0, 9)}</p>" for _ in range(rnd.randint(0, 4))]
        page = "".join(parts) + rnd.choice(["<div class='share history'>Share it</div>", "<div>All rights</div>", ""])
        rows.append((k, f"http://{host}/{rnd.choice('xy')}/{rnd.randint(0, 40)}", rnd.choice([page, f"<article>{page}</article>", "", page])))
    rows.append((200, "http://c.org", "<p>alone"))
    want = slow_text(rows)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 50):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(table.repartition(parts)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == {k: (t, len(t)) for k, t in want.items()}


def test_cut_repeated_and_empty_tables(spark):
    cut = "<p>ok</p><a " + "x='1' \"y " * 20000
    rows = [(1, "http://h.org/1", cut)] * 2 + [(None, None, cut), (2, "http://h.org/2", "<p>a <b>b</b></p>" * 5000)]
    got = sorted((r.page_id or 0, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:3] == [(0, "ok"), (1, "ok"), (1, "ok")] and got[3][1] == " ".join(["a b"] * 5000)
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_names_that_hint_at_a_frame_drop_no_text_of_an_article():
    text = lambda s: pages.main_text(pages.lines(s), None)
    assert text("<main><h1>T</h1><p>One.</p><article>card</article><p>Two.</p></main>") == "T One. card Two."
    assert text("<article><p>Let <math>x=2</math> hold.</p><section class='social history'>S</section><h2 id='search'>Search trees</h2></article>") == "Let x=2 hold. S Search trees"
    assert text("<article><p class=ad>Buy<p>text<div class='related-posts'>no</div></article>") == "text"
