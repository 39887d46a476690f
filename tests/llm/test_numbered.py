"""The numbered operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from array import array
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import chat, exact_dedup, language, leaks, licenses, packing, pages, simhash, token_counts, token_files, units
from fathomline.llm.common import new_folder

RND = random.Random(5)
WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "and", "naïve", "Größe", "日本"]
EXTRA = "fp long, label string, digest string, b string, k string, s string, words string, row string, host string"
CASES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two"), (6, "one two three four five six"),
    (7, "ONE two\nthree four  five six"), (8, "naïve Größe 日本 don't <|endoftext|> </s> \x1c\x85"), (None, "one two three four five six"),
    (9, " ".join(RND.choice(WORDS) for _ in range(9000))), (10, "x" * 5000), (-11, "12 34 5.6,7"), (12, "..."),
]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, t, 7, "a", "b", "c", "d", "e", "f", "g", "h") for i, t in CASES]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


def key(v):
    return tuple((x is not None, x if x is not None else 0) for x in v)


# 1 ---------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(marked, radius=2):
    root = list(range(len(marked)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marked)):
        for j in range(i):
            if (marked[i][1] ^ marked[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(marked):
        groups.setdefault(find(i), []).append(doc)
    return {i: min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(marked))}


def test_simhash_is_brute_force(spark, cases):
    base = prose(400)
    near = [(100 + i, base + " " + prose(i % 3)) for i in range(12)] + [(200 + i, prose(40)) for i in range(30)]
    docs = cases.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    given = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    parts = slow_components(given)
    want = sorted(((d, f"{fp:016x}", parts[i]) for i, (d, fp) in enumerate(given)), key=key)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == want


def test_simhash_links_chains(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(12):
        f = rnd.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                f ^= 1 << b
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from fathomline.llm.components import components

    found = {r.node: r.label for r in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    marked = [(f, f & (1 << 64) - 1) for (f,) in signed]
    want = {marked[i][0]: c for i, c in slow_components(marked).items()}
    assert {f: found.get(f, f) for f, _ in marked} == want


def test_simhash_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.similarity_classes(nothing).count() == 0


def test_similarity_classes_are_brute_force(spark, cases):
    rnd = random.Random(6)
    fresh = lambda n: [f"v{rnd.randint(0, 99999)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = fresh(rnd.randint(60, 400))
        texts.append(" ".join(base))
        for share in (0.004, 0.01, 0.03, 0.08):
            w = list(base)
            for k in rnd.sample(range(len(w)), max(1, int(share * len(w)))):
                w[k] = "changed"
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 100))
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if j < i}
    root = {i: i for i in sets}
    for (i, j), s in sorted(alike.items()):
        if s >= 0.8:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if v == old else v for k, v in root.items()}
    docs = cases.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in simhash.similarity_classes(docs).collect()}
    assert sum(got[i] == root[i] for i in sets) >= 0.97 * len(sets)
    assert all(root[i] == root[got[i]] for i in sets)  # nothing joins that is not alike
    assert got[4] == 4 and got[1] == got[2] == got[3] == 1 and got[9] == 9 and got[6] == got[None] == 6


# 2 ---------------------------------------------------------------------------------------------

FRAME = '<html><head><title>t</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body class="sidebar"><nav><ul><li>Menu</li></ul></nav>'


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        (FRAME + "<!-- <p>no</p> --><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>f&eacute;<i>t</i>e</article><footer>end</footer>", "A & B one two three féte"),
        (FRAME + "<article><header><h1>T</h1></header><p>x</p><aside>no</aside><div id='comments'><p>no</p></div><form>no</form><p>y</p></article>", "T x y"),
        (FRAME + "<main><div class='cookie-notice'>no</div><p>x</p></main><p>out</p>", "x"),
        (FRAME + "<article><p title=\"a>b\">x</p></article><article class='comment'>no</article>", "x no"),
        ("plain text &lt;b&gt; only", "plain text <b> only"),
        ("<p>a</p><div hidden>no</div><div style='display: none'>no</div><p>b", "a b"),
    ],
)
def test_page_text(source, text):
    assert pages.main_text(pages.lines(source), None) == text


def test_pages_lose_what_neighbours_share(spark):
    page = lambda t: f"<div>Site name</div><p>{t}</p><div>All rights</div>"
    rows = [(i, f"http://h.org/a/{i}", page(f"own text {i}"), "x") for i in range(5)] + [(9, "http://other.org/", page("alone"), "x"), (10, None, None, "x"), (None, "http://h.org/a/1#top", "", "x")]
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()}
    assert got[2] == ("own text 2", 10) and got[9][0] == "Site name alone All rights" and got[10] == ("", 0) and got[None] == ("", 0)
    assert len(got) == len(rows)


def test_shared_is_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(pages.shared(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


# 3 ---------------------------------------------------------------------------------------------


def slow_ids(text, name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(units.vocabulary(name)).encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, cases):
    folder = new_folder(spark, "t")
    token_files.write(cases, folder)
    by_start = {}
    for r in token_files.read(spark, folder).collect():
        by_start.setdefault((r.start, r.doc_id), []).append((r["at"], np.frombuffer(r.ids, "<u4").tolist()))
    got = [(d, sum((ids for _, ids in sorted(p)), [])) for (s, d), p in sorted(by_start.items(), key=lambda x: x[0][0])]
    assert sorted(map(str, got)) == sorted(str((d, slow_ids(t) + [0])) for d, t in CASES)
    assert [d for d, _ in got if d is not None] == sorted(d for d, _ in got if d is not None)
    starts = np.cumsum([0] + [len(i) for _, i in got])[:-1].tolist()
    found = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, folder).collect())
    assert found == [(s, len(i), zlib.crc32(array("I", i).tobytes())) for s, (_, i) in zip(starts, got, strict=True)]


def test_token_files_split_long_documents(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    docs = spark.createDataFrame([(i, prose(n)) for i, n in enumerate((5, 400, 0, 33, 1000))], "doc_id long, text string")
    folder = new_folder(spark, "t")
    token_files.write(docs, folder)
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, folder).collect()}
    assert found == {r.doc_id: (len(i), zlib.crc32(array("I", i).tobytes())) for r in docs.collect() for i in [slow_ids(r.text) + [0]]}


def test_token_files_of_nothing(spark, nothing):
    folder = new_folder(spark, "t")
    token_files.write(nothing, folder)
    assert token_files.digests(spark, folder).count() == 0


def test_code_lengths():
    import heapq

    rnd = random.Random(2)
    for n in (1, 2, 3, 40, 300):
        counts = [int(2 ** (rnd.random() * 20)) + 1 for _ in range(n)]
        lengths = token_files.code_lengths(np.array(counts), 30)
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        cost, at = 0, n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], at))
            at += 1
        assert n == 1 or int((lengths * counts).sum()) == cost
        short = token_files.code_lengths(np.array(counts), 9)
        assert short.max() <= 9 and sum(2.0**-x for x in short) <= 1


# 4 ---------------------------------------------------------------------------------------------


def slow_licenses(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    found = {}
    for name, t in licenses.TEMPLATES:
        v = re.findall(r"[^\W_]+", t.lower())
        want = {tuple(v[i : i + 3]) for i in range(len(v) - 2)}
        best = max((len(want & {tuple(w[j : j + 3]) for j in range(i, min(i + len(v), len(w)) - 2)}) / len(want) for i in range(max(1, len(w)))), default=0)
        if best >= licenses.CONTAINED:
            found[name] = 1.0 if best == 1 else round(best, 6)
    return found


def test_licenses_are_brute_force(spark, cases):
    texts = [None, "", "MIT License"]
    for _, t in licenses.TEMPLATES:
        texts += [t, f"{prose(37)} {t.upper()} {prose(50)}", t.replace("License", "Thing").replace("license", "thing")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    want = {i: f for i, t in enumerate(texts) if (f := slow_licenses(t))}
    assert {i: set(f) for i, f in got.items()} == {i: set(f) for i, f in want.items()}
    assert all(got[i][k] >= v - 1e-6 for i, f in want.items() for k, v in f.items())
    assert licenses.scan(cases).count() == 0
    assert licenses.scan(cases, templates=()).count() == 0


# 5 ---------------------------------------------------------------------------------------------


def test_packing_places_each_id_once(spark, cases):
    given = {}
    rows = packing.pack(cases.where("doc_id IS NOT NULL AND doc_id <> 4")).collect()
    for d, t in CASES:
        if d not in (None, 4):
            given[d] = slow_ids(t, "word_bpe_49k.json") + [2]
    for d, ids in given.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at.bit_count() == 1
    assert packing.pack(cases).groupBy().sum("length").first()[0] == sum(map(len, given.values())) + 2 * (len(slow_ids("one", "word_bpe_49k.json")) + 1) + len(given[6])


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


def test_packer_opens_long_windows_first():
    p = packing.Packer(0, tiers=(8, 16), window=4, step_windows=2)
    for i, n in enumerate((16, 9, 5, 3, 7, 2, 20)):
        p.add(i, bytes(4 * n))
    p.finish()
    rows = p.rows()
    assert sum(rows["length"]) == 62 and set(rows["tier"]) <= {1, 2, 4, 8, 16} and rows["tier"].count(16) >= 3


# 6 ---------------------------------------------------------------------------------------------

HARD = ["", None, "a\\", "\\</s>", "\\\\[INST] x", "</s>\n</s>", "\n<sep>\n", "<s>user\nhi\n</s>", "<|im_start|>", "<<SYS>>%0A%25", "日本\r\n", "<</s>>"]


def test_chat_reads_back(spark):
    rows = [(c, t, RND.choice(["user", "assistant", "system", "assistant", "a%\nb</s>", None]), RND.choice(HARD)) for c in range(40) for t in range(RND.randint(1, 7))]
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 1, "user", "x"), (50, None, "user", "late"), (50, 1, "user", "x")]
    out = chat.formatted(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, blocks string"))
    made = {r.conv_id: r for r in out.select("conv_id", "text", chat.parsed(out.text).alias("turns"), chat.loss_text(out.text, out.loss_spans).alias("loss")).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(made) == set(groups)
    for c, turns in groups.items():
        want = [(r, t) for _, _, r, t in sorted(turns)]
        assert [tuple(x) for x in made[c].turns] == want
        assert made[c].loss == "".join(t for r, t in want if r == "assistant")


def test_chat_merges_adjacent_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).first().text == "<s>user\na\n<sep>\nb\n</s><s>assistant\nc\n</s>"
    assert chat.formatted(df.limit(0)).count() == 0


# 7 ---------------------------------------------------------------------------------------------


def test_exact_dedup_is_brute_force(cases, nothing):
    norm = [(d, t or "", hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()) for d, t in CASES]
    want = []
    for d, _, h in norm:
        mine = sorted((-len(u), e is None, e or 0) for e, u, g in norm if g == h)
        keep = None if mine[0][1] else mine[0][2]
        want.append((d, keep, len(mine), d == keep, h))
    got = exact_dedup.groups(cases).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert exact_dedup.groups(nothing).count() == 0


def test_cuckoo_filter_has_no_false_negatives():
    rnd = random.Random(4)
    keys = [rnd.randbytes(32) for _ in range(3000)]
    b = exact_dedup.Bucket()
    for k in keys:
        b.insert(k, 1, 1, 1)
    assert all(k in b.filter for k in keys) and b.filter.size == 3000 and b.filter.places > 256
    for k in keys[:2000]:
        b.remove(k)
    assert b.filter.size == 1000 and all(k in b.filter for k in keys[2000:])
    image = exact_dedup.CuckooFilter.of_image(b.filter.image())
    assert all(k in image for k in keys[2000:]) and sum(k in image for k in keys[:2000]) < 20


def test_index_deletes_and_inserts(spark):
    docs = spark.createDataFrame([(1, "a a"), (2, "aa"), (3, "aa"), (4, "b"), (5, "c")], "doc_id long, text string")
    live = exact_dedup.digested(docs)
    stored = exact_dedup.insert(live, 4)
    rest = exact_dedup.delete(stored, live, spark.createDataFrame([(1,), (4,)], "doc_id long"), 4)
    assert sorted((r.keep_id, r.group_size) for r in rest.where("kind = 'entry'").collect()) == [(2, 2), (5, 1)]
    more = exact_dedup.insert(exact_dedup.digested(spark.createDataFrame([(6, "b"), (7, " aa ")], "doc_id long, text string")), 4, rest)
    assert sorted((r.keep_id, r.group_size) for r in more.where("kind = 'entry'").collect()) == [(5, 1), (6, 1), (7, 3)]


# 8 ---------------------------------------------------------------------------------------------


def slow_leak(doc, item):
    a, b = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (doc, item))
    if len(b) < leaks.SHORTEST:
        return bool(b) and a == b
    for s in range(-len(b), len(a) + 1):
        same = [0 <= s + k < len(a) and a[s + k] == w for k, w in enumerate(b)]
        if sum(same) >= leaks.ALIKE * len(b):
            return True
        best = now = 0
        for x in same:
            now = max(0, now + (1 if x else -3))
            best = max(best, now)
        if best >= leaks.PART:
            return True
    return False


def test_leaks_are_brute_force(spark, cases, nothing):
    fresh = lambda n: " ".join(f"q{RND.randint(0, 9999)}" for _ in range(n))
    items = [(i, fresh(n)) for i, n in enumerate((1, 3, 5, 8, 15, 20, 40, 59))] + [(90, None), (91, "")]
    texts = []
    for _, t in items[:8]:
        w = t.split()
        texts += [t, f"{fresh(30)} {t.upper()}, {fresh(9)}", fresh(50) + " " + " ".join(w[: len(w) // 2])]
        for n in (1, 2, 3, 8):
            v = list(w)
            for k in RND.sample(range(len(w)), min(n, len(w))):
                v[k] = "changed"
            texts.append(f"{fresh(12)} {' '.join(v)} {fresh(12)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    got = {(r.doc_id, r.item_id) for r in leaks.overlaps(docs, bench).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, u in items if slow_leak(t, u)}
    assert got == want
    assert leaks.overlaps(cases, bench).count() == leaks.overlaps(nothing, bench).count() == leaks.overlaps(docs, bench.limit(0)).count() == 0
    assert {r.doc_id for r in leaks.decontaminated(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in got}


def test_leaks_find_every_change_of_short_items(spark):
    items, texts = [], []
    for n in range(5, 16):
        w = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        for at in combinations(range(n), n // 5):
            texts.append((n, f"before {' '.join('changed' if k in at else x for k, x in enumerate(w))} after all of this"))
        texts.append((None, " ".join(w[: n // 2])))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, n) for i, (n, _) in enumerate(texts) if n}


def test_leaks_across_segments_and_with_repeated_or_null_ids(spark):
    item = [f"z{k}" for k in range(20)]
    filler = [f"f{k}" for k in range(leaks.SEGMENT - 11)]
    docs = spark.createDataFrame([(1, " ".join(filler + item + filler)), (1, "nothing here"), (None, " ".join(item)), (None, "else")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (None, " ".join(item[:6]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.overlaps(docs, bench).collect()} == {(1, 7), (None, 7), (1, None), (None, None)}


# 9 ---------------------------------------------------------------------------------------------


def test_language(spark, cases, nothing):
    rnd = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["ção", "ão", "nh"]}
    rows = [(i, " ".join("".join(rnd.choices(parts[g], k=3)) for _ in range(rnd.randint(1, 60))), g) for i in range(600) for g in [rnd.choice(list(parts))]]
    rows += [(1000, None, "aa"), (1001, "123 ...", "aa"), (1002, "kalomi", None), (None, "kalomi loka", "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    held = [r for r in rows[:600] if got[r[0]].held_out]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows[:600])
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held) > 80
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa" and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in language.recognised(docs).collect()} == {r[0] for r in rows} - {1000, 1001}
    blank = cases.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language.identified(blank).collect()} == {"und"}
    assert language.identified(nothing.selectExpr("doc_id", "text", "label AS lang")).count() == 0


def test_language_leaves_no_letters_out(spark):
    learned = [(i, text, lang) for i in range(40) for text, lang in [("the cat sat on the mat", "en") if i % 2 else ("der Hund liegt im Gras", "de")]]
    odd = [(1000, "\U00031350\U00031351", None), (1001, "\U00010570", None), (1002, "12 \u0870", None), (1003, "12 \u2163 \u00b2", None), (1004, "", None), (1005, None, None)]
    docs = spark.createDataFrame(learned + odd, "doc_id long, text string, lang string")
    want = {i for i in range(40)} | {1000, 1001, 1002}
    got = {r.doc_id: r.lang_pred for r in language.identified(docs).collect()}
    assert {i for i in got if got[i] in ("de", "en")} == want and all(got[i] == "und" for i in (1003, 1004, 1005))
    for lang in ("lang", "CAST(NULL AS STRING)", "replace(lang, 'de', 'und')"):
        assert {r.doc_id for r in language.recognised(docs.selectExpr("doc_id", "text", f"{lang} AS lang")).collect()} == want
    numbers = spark.createDataFrame([(1, "12 34", "num"), (2, "the cat", "en"), (3, None, "none")], "doc_id long, text string, lang string")
    assert language.fit(numbers).names == ["en", "num"]


def test_codewords_lie_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = language.codewords(n)
        least = min((code[i] ^ code[j]).sum() for i in range(n) for j in range(i))
        assert least >= (1 if n == 2 else 2) and not (code.all(0) & (n > 1)).any() and code.any(0).all()


# 10 --------------------------------------------------------------------------------------------


def test_token_counts_are_the_library(cases, nothing):
    got = sorted(map(tuple, token_counts.token_counts(cases).collect()), key=key)
    want = [(d, len((t or "").encode()), n, n > 1024) for d, t in CASES for n in [len(slow_ids(t))]]
    assert got == sorted(want, key=key)
    assert token_counts.token_counts(nothing).count() == 0


ATOMS = ["a", "b", "it", "'s", "'", "'re", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!", "_", "1", "²", "é", "́", "İ", "Σ", "中", "　", "\x1c", "\x85", "<|endoftext|>", "<|", "%%%", "😀", " The", "tion", "aaaa"]


@pytest.mark.parametrize("chunk", [3, 11, 1 << 16])
def test_chunk_maps_compose(monkeypatch, chunk):
    rnd = random.Random(chunk)
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    count, encode = token_counts.Transducer(units.vocabulary("byte_bpe_50k.json")), units.encoder(units.vocabulary("byte_bpe_50k.json"))
    for _ in range(500):
        t = "".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 16)))
        ids = encode.library.encode(t, add_special_tokens=False).ids
        assert count(t) == len(ids) and encode(t) == array("I", ids).tobytes(), repr(t)


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_the_word_tokenizer(seed):
    rnd, encode = random.Random(seed), units.encoder(units.vocabulary("word_bpe_49k.json"))
    for _ in range(500):
        t = "".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 16)))
        assert encode(t) == array("I", encode.library.encode(t, add_special_tokens=False).ids).tobytes(), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_joined_words_have_the_ids_of_each(name):
    rnd, encode = random.Random(3), units.Encoder(units.vocabulary(name))
    letters = "abcXYZéèßñǅαжЖ日本語각ㄱªſﬁİ" + "가\U0001e030\U0003134a"
    pieces = [" " + "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    pieces += [" ", "\n", "a", " 12", " é", " <|endoftext|>", "...", " x" * 3] + [" " + "ab" * 500] * 2
    rnd.shuffle(pieces)
    assert encode.ids(pieces) == [array("I", x).tobytes() for x in encode.library_ids(pieces)]
    assert encode.ids([]) == []


@pytest.mark.parametrize("window", [1, 7, 1 << 23])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_columns_have_the_ids_of_each_text(monkeypatch, name, window):
    monkeypatch.setattr(units, "WINDOW", window)
    rnd, encode = random.Random(window), units.Encoder(units.vocabulary(name))
    atoms = [*ATOMS, " don't", " été,", "\nFoo.", "\xa0", " ", " ", "»", "”", "ſ", "٣", "\r\n", "</s>", "-", "ñ:"]
    texts = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 16))) for _ in range(1500)] + [None, "", "x" * 999, " ", None]
    ids, counts = encode.column(pa.array(["left out", *texts]).slice(1))
    want = [e.ids for e in encode.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    for kind in (pa.string(), pa.large_string()):
        ids, counts = encode.column(pa.array(texts[::-1], kind), "<u2")
        assert ids.dtype == "<u2" and counts.tolist() == list(map(len, want[::-1])) and ids.tolist() == sum(want[::-1], [])
    assert [x.tolist() for x in encode.column(pa.array([], pa.string()))] == [[], []]
    for t in texts:
        if t:
            cuts = {len("".join(units.CUTS.findall(t)[:k]).encode()) for k in range(len(t))}
            assert set(units.starts(np.frombuffer(t.encode(), np.uint8), np.zeros(1, int)).tolist()) <= cuts, repr(t)


def test_a_column_looks_each_piece_up_once(spark, monkeypatch):
    """Cost of the token files: pieces asked of the memory of pieces, by any of its ways."""
    asked = []
    for way in ("values", "distinct"):
        if plain := getattr(units.Kept, way, None):
            monkeypatch.setattr(units.Kept, way, lambda self, pieces, find, plain=plain: asked.extend(pieces) or plain(self, pieces, find))
    docs = pa.record_batch({"doc_id": [1, 2], "row": [0, 1], "text": ["the cat, the cat. " * 500, "the cat, the dog. " * 500]})
    held = {}
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: held.setdefault("run", run) and self)
    token_files.tokenised(spark.createDataFrame([], "doc_id long, text string"), "byte_bpe_50k.json", 0)
    (made,) = held["run"](iter([docs]))
    for text, n, ids in zip(*(made.column(c).to_pylist() if c != "text" else docs.column(c).to_pylist() for c in ("text", "n", "ids")), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == slow_ids(text) + [0] and n == len(ids) // 2
    assert len(asked) < 20
