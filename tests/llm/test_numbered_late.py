"""Operators 11 to 13 against brute force, and their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import minhash, phrases, runs, shingles

WORDS = [f"w{i}" for i in range(40)] + ["the", "of", "naïve", "Größe", "日本"]
EXTRA = "n long, node string, key string, gram string, f string, size long, label string"


def wide(spark, rows):
    """(doc_id, text, lang) rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d", 2, "e") for r in rows], f"doc_id long, text string, lang string, {EXTRA}").repartition(3)


def split(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# 11 --------------------------------------------------------------------------------------------


def shingle_texts(text, words=3):
    w = split(text)
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def slow_classes(rows, percent=85):
    sets = [shingle_texts(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and root[i] != root[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    out = []
    for i, (doc, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def near_rows():
    rnd = random.Random(6)
    fresh = lambda n: [f"v{rnd.randint(0, 99999)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (4, "one"), (5, "one two"), (None, "one two"), (None, "one two three four"), (None, None), (6, "ONE two\nthree  four"), (-7, "a " * 3000)]
    for _ in range(12):  # 17 of 20 shingles, 20 of 23.5, and just under
        w = fresh(22)
        rows += [(rnd.randint(10, 999), " ".join(w)), (rnd.randint(10, 999), " ".join(w[:-3] )), (rnd.randint(10, 999), " ".join(w[:-4])), (rnd.randint(10, 999), " ".join([*w, *fresh(3)]))]
    base = fresh(120)
    for _ in range(30):  # a crowd: alike to the base by about 0.8 to 0.95, less to each other
        w = list(base)
        for k in rnd.sample(range(120), rnd.randint(1, 5)):
            w[k] = fresh(1)[0]
        rows.append((rnd.randint(1000, 9999), " ".join(w)))
    passage = fresh(80)
    rows += [(rnd.randint(1000, 9999), " ".join(fresh(20) + passage + fresh(20))) for _ in range(25)]
    rnd.shuffle(rows)
    return [(i, t, "en") for i, t in rows]


def test_minhash_classes_are_brute_force(spark, monkeypatch):
    rows = near_rows()
    for crowd in (2, 16):  # the path of crowded buckets and the plain one
        monkeypatch.setattr(minhash, "CROWD", crowd)
        got = [tuple(r) for r in minhash.near_duplicates(wide(spark, rows)).collect()]
        assert sorted(got, key=key) == sorted(slow_classes(rows), key=key)


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(wide(spark, [])).count() == 0
    got = minhash.near_duplicates(wide(spark, [(1, None, None), (2, "", None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def slow_signature(held):
    """The least of rank and fraction over shingles, by walking through each permutation."""
    least = [int(minhash.FAR)] * minhash.PLACES
    for x in held.tolist():
        one = np.array([x], np.uint64)
        drawn = int(minhash.mixed(one, 1)[0])
        place, step = (drawn >> 32) % minhash.PLACES, (drawn & 0xFFFFFFFF) % (minhash.PLACES - 1) + 1
        for rank in range(minhash.PLACES):
            least[place] = min(least[place], rank << 32 | int(minhash.mixed(one, rank + 2)[0]) >> 32)
            place = (place + step) % minhash.PLACES
    return least


def test_signatures_stop_early_without_a_difference(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype="<u8")) for n in (0, 1, 2, 7, 90, 700)]
    want = [slow_signature(s) for s in sets]
    assert minhash.signatures(sets).tolist() == want
    monkeypatch.setattr(minhash, "HELD", 64)  # texts in parts
    assert minhash.signatures(sets).tolist() == want


def test_signature_shares_estimate_the_similarity_with_less_variance():
    rng, met = np.random.default_rng(3), []
    shares = []
    for n in (20, 100, 400):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, n, dtype="<u8")
            lost = rng.permutation(n)[: n - round(0.85 * n)]
            half = len(lost) // 2
            a, b = minhash.signatures([np.delete(both, lost[:half]), np.delete(both, lost[half:])])
            shares.append((a == b).mean())
            met.append(len(np.intersect1d(*minhash.band_keys(np.stack([a, b])))))
    assert abs(np.mean(shares) - 0.85) < 0.005 and np.std(shares) < (0.85 * 0.15 / minhash.PLACES) ** 0.5
    assert min(met) >= 3


# 12 --------------------------------------------------------------------------------------------


def slow_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q) and i > s:
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_brute_force(least):
    rnd = random.Random(least)
    for _ in range(400):
        w = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 50))]
        if w and rnd.random() < 0.6:
            at = rnd.randrange(len(w))
            w = w[:at] + (w[at:] * 6)[: rnd.randint(1, 60)]
        assert sorted(runs.runs_in(w, least)) == slow_runs(w, least)


def test_suffix_tree_against_all_pairs():
    rnd = random.Random(9)
    for _ in range(60):
        w = [rnd.randrange(3) for _ in range(rnd.randint(1, 40))]
        tree, n = runs.SuffixTree(w), len(w)
        order = sorted(range(n + 1), key=lambda i: w[i:])  # noqa: B023
        assert [int(tree.rank[i]) for i in order] == list(range(n + 1))
        other = sorted(range(n + 1), key=lambda i: [-x for x in w[i:]])  # noqa: B023
        assert [int(tree.turned()[i]) for i in other] == list(range(n + 1))
        i, j = (np.array(x) for x in zip(*((a, b) for a in range(n + 1) for b in range(n + 1) if a != b), strict=True))
        lcp = [next((k for k in range(n + 1) if a + k >= n or b + k >= n or w[a + k] != w[b + k]), n) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert tree.common(i, j).tolist() == lcp


def test_runs_of_documents(spark):
    rnd = random.Random(1)
    unit = [f"u{k}" for k in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 11), (5, "x " * 12), (5, "x\t" * 12), (None, "ab cd " * 9), (6, "日本 é " * 30), (7, " ".join(unit * 3 + unit[:7])), (8, "same X x " * 8), (9, " ".join(rnd.choice(WORDS) for _ in range(30000)))]
    rows = [(i, t, None) for i, t in rows]
    got = {(r.doc_id, tuple(r.collapsed.split(" ")[:2])): r for r in runs.periodic_runs(wide(spark, rows)).collect()}
    assert len(got) == 10 and runs.periodic_runs(wide(spark, [])).count() == 0  # the two rows of 5 agree
    for doc, text, _ in rows:
        words = (text or "").split()
        want = slow_runs(words, 12) if doc != 9 else []
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        r = got[doc, tuple(left.split(" ")[:2])]
        assert [tuple(x) for x in r.runs] == sorted(want, key=lambda x: (x[0], x[2])) and r.collapsed == left


def test_made_periodic():
    words = [b"%d" % k for k in range(50)]
    changed = [i for i in range(300) if runs.made_periodic(i, words) != words]
    assert 15 <= len(changed) <= 45 and runs.made_periodic(changed[0], []) == [] and runs.made_periodic(None, words) == words


# 13 --------------------------------------------------------------------------------------------


def slow_phrases(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            held = f.setdefault(lang, Counter())
            for k in range(1, 6):
                held.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, held in f.items():
        known = {p: c for p, c in held.items() if len(p) > 1 and c >= least}
        inside = {(p[i:j], c) for p, c in known.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        scored = []
        for p, a in known.items():
            if (p, a) in inside:
                continue
            cuts = [(1000 * a * n[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rnd = random.Random(8)
    vocab, fixed = [f"t{k}" for k in range(12)] + ["é", "日本"], ["alpha beta gamma delta epsilon zeta eta theta", "New york city", "a a a a a a", "x y x y x y x y"]
    rows = [(None, None, None), (1, "", "en"), (2, ".,;:!?\n\x0b\x0c\r", None), (3, "one", "und")]
    for k in range(160):
        parts = []
        for _ in range(rnd.randint(1, 8)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.4 else " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 9))))
        rows.append((k, rnd.choice([". ", " ", "\t", ",", "\n"]).join(parts), rnd.choice(["en", "de", None])))
    return rows + rows[-3:]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (12, 7), (40, 2000)])
def test_phrases_are_brute_force(spark, least, top):
    rows = phrase_rows()
    got = sorted(tuple(r) for r in phrases.collocations(wide(spark, rows), least, top).collect())
    assert got == slow_phrases(rows, least, top) and got


def test_phrases_of_nothing(spark):
    assert phrases.collocations(wide(spark, []), 2).count() == 0
    assert phrases.collocations(wide(spark, [(1, "a b c", "en")]), 2).count() == 0


def test_paths_join_edges_of_one_weight(spark):
    chain = [f"c{k}" for k in range(40)]
    grams = [(" ".join(chain[k : k + 5]), 9) for k in range(36)] + [("a a a a a", 5)]
    ring = ["r0", "r1", "r2", "r3", "r4", "r5"]
    grams += [(" ".join((ring * 2)[k : k + 5]), 4) for k in range(6)]
    grams += [("b1 b2 b3 b4 b5", 7), ("b2 b3 b4 b5 b6", 6)]  # the weight changes: no path
    found = phrases.paths(spark.createDataFrame([("en", g, n) for g, n in grams], "lang string, gram string, f long"))
    got = sorted((r.path, r.f) for r in found.collect())
    want = [(" ".join(chain), 9), *[g for g in grams if g[1] != 9]]
    assert got == sorted(want)


def test_a_full_bitmap_changes_no_count(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "KEY_BITS", 0.001)
    monkeypatch.setattr(phrases.Bitmap, "__call__", lambda self, keys: np.ones(len(keys), bool))
    assert sorted(tuple(r) for r in phrases.collocations(wide(spark, rows), 12).collect()) == slow_phrases(rows, 12, 2000)


def test_shingle_names_tell_sets_apart():
    assert shingles.node_of(np.array([1, 2], "<u8")) != shingles.node_of(np.array([2, 1], "<u8"))
