"""Similarity classes beside brute force where bands of sketches lose links."""

import random

import numpy as np
import pytest

from fathomline.llm import shingles, simhash


def classes(rows):
    """The least id of each class by comparing all pairs."""
    sets = {i: set(shingles.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    return root


def short(rnd):
    """Pairs of exactly 4 against 5, 12 against 15 and 20 against 25 shingles."""
    texts = []
    for n in (8, 16, 24) * 40:
        w = [f"v{rnd.randint(0, 99999)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w + [f"e{rnd.randint(0, 99999)}" for _ in range((n - 4) // 4)])]
    return texts


def crowded(rnd):
    """Documents with one long passage, alike by 0.5 to 0.79, and near copies of some of them."""
    fresh = lambda n: [f"v{rnd.randint(0, 99999)}" for _ in range(n)]
    passage, texts = fresh(300), []
    for k in range(60):
        w = passage + fresh(60)
        texts.append(" ".join(w))
        at = rnd.randrange(300, 355)
        texts.append(" ".join(w[:at] + fresh(3) + w[at:] + fresh(60)))
    return texts


@pytest.mark.parametrize("made", [short, crowded])
def test_classes_lose_no_link(spark, made):
    rows = list(enumerate(made(random.Random(3))))
    random.Random(4).shuffle(rows)
    got = {r.doc_id: r.component_id for r in simhash.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes(rows)
    assert len(set(want.values())) < len(rows)
    assert got == want


def test_sketches_rule_out_no_alike_pair():
    rnd, ruled_out = np.random.default_rng(5), 0
    for n in (0, 1, 3, 15, 17, 64, 127, 400):
        for more in (0, 1, n // 8, n // 4, n // 3, n, 4 * n):
            for lost in (0, n // 9, n // 5):
                p = np.unique(rnd.integers(0, 1 << 63, n, dtype="<u8"))
                q = np.unique(np.concatenate([p[lost:], rnd.integers(0, 1 << 63, more, dtype="<u8")]))
                same = len(np.intersect1d(p, q))
                alike = 100 * same >= 80 * (len(p) + len(q) - same)
                got = shingles.may_be_alike(shingles.sketch(p), shingles.sketch(q), len(p), len(q), 80)
                assert got or not alike
                ruled_out += not got
    assert ruled_out > 50
