"""Layout measures beside plain loops."""

import itertools
import random

from fathomline.operators import layout


def made(seed, n=25, m=60):
    rnd = random.Random(seed)
    at = {k: (rnd.randint(0, 9) + (k % 3) / 10, rnd.randint(0, 9)) for k in range(n)}
    return at, [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


def side(p, q, r):
    v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (v > 0) - (v < 0)


def frames(table, at, edges):
    return table([(k, float(x), float(y)) for k, (x, y) in at.items()], "node int, x double, y double"), table(edges, "a int, b int")


def test_crossings(table):
    at, edges = made(1)
    want = sum(
        not {*e} & {*f} and side(at[e[0]], at[e[1]], at[f[0]]) * side(at[e[0]], at[e[1]], at[f[1]]) < 0 and side(at[f[0]], at[f[1]], at[e[0]]) * side(at[f[0]], at[f[1]], at[e[1]]) < 0
        for e, f in itertools.combinations(edges, 2))
    for cells in (1, 7, 32):
        r = layout.crossings(*frames(table, at, edges), cells).first()
        assert (r.crossing, r.edges, r.fraction) == (want, len(edges), want / len(edges) ** 2) and want
    assert tuple(layout.crossings(*frames(table, at, [])).first()) == (0, 0, 0.0)


def test_stress_and_distances(table):
    at, edges = made(2, 20, 18)
    near = {k: {b for a, b in edges if a == k} | {a for a, b in edges if b == k} for k in at}
    far = {}
    for s in (k for k in at if near[k] - {k}):
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [b for b in {b for a in front for b in near[a]} if b not in seen]
            seen |= dict.fromkeys(front, d)
        far |= {(s, v): d for v, d in seen.items()}
    nodes, links = frames(table, at, edges)
    assert {(r.source, r.node): r.steps for r in layout.distances(links).collect()} == far
    num = den = 0
    for (s, v), d in far.items():
        if d:
            size = ((at[s][0] - at[v][0]) ** 2 + (at[s][1] - at[v][1]) ** 2) ** 0.5
            num, den = num + d * ((size - d) / max(size, d)) ** 2, den + d
    r = layout.stress(nodes, links).first()
    assert abs(r.stress - num / den) < 1e-9 and r.pairs == sum(d > 0 for d in far.values())
    assert tuple(layout.stress(nodes, links.limit(0)).first()) == (0, 0.0)


def test_hulls(table):
    rnd = random.Random(3)
    rows = [("square", float(x), float(y)) for x in range(6) for y in range(6)] + [("line", float(k), float(k)) for k in range(5)] + [("one", 1.0, 1.0), ("one", 1.0, None)]
    rows += [("round", rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(500)]
    found = {r.g: r for r in layout.hulls(table(rows, "g string, x double, y double"), "g").collect()}
    assert found["square"].area == 25 and len(found["square"].corners) == 4 and found["line"].area == 0 and len(found["one"].corners) == 1
    ring = [(p.x, p.y) for p in found["round"].corners]
    assert all(side(a, b, (x, y)) >= 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True) for g, x, y in rows if g == "round")


def test_every_pair_of_edges_meets_in_one_task(table, monkeypatch):
    at, edges = made(4, 25, 90)
    whole = tuple(layout.crossings(*frames(table, at, edges), 1).first())
    monkeypatch.setattr(layout, "BLOCK", 7)
    assert tuple(layout.crossings(*frames(table, at, edges), 1).first()) == whole and whole[0]


def test_stress_writes_no_pairs_down(table, monkeypatch):
    at, edges = made(5, 40, 45)
    nodes, links = frames(table, at, edges)
    nodes = nodes.unionByName(table([(3, 1.0, 2.0), (4, None, 2.0), (99, 0.0, 0.0)], "node int, x double, y double"))
    some = table([(k,) for k in range(0, 40, 3)], "source int")
    ring = table([(k, (k + 1) % 600) for k in range(600)], "a int, b int")
    round_ = table([(k, float(k % 7), float(k % 11)) for k in range(600)], "node int, x double, y double")
    cases = [(nodes, links, some), (nodes.withColumn("node", nodes.node.cast("string")), links.selectExpr("cast(a as string) a", "cast(b as string) b"), None)]
    monkeypatch.setattr(layout, "WHOLE", 0)
    want = [tuple(layout.stress(*c).first()) for c in cases]
    monkeypatch.undo()
    monkeypatch.setattr(layout, "distances", None)
    monkeypatch.setattr(layout, "HELD", 1 << 9)
    for c, (pairs, value) in zip(cases, want, strict=True):
        r = layout.stress(*c).first()
        assert r.pairs == pairs > 0 and abs(r.stress - value) < 1e-9
    # distances over 255
    num = den = 0
    for a, b in itertools.permutations(range(600), 2):
        d = min((a - b) % 600, (b - a) % 600)
        size = ((a % 7 - b % 7) ** 2 + (a % 11 - b % 11) ** 2) ** 0.5
        num, den = num + d * ((size - d) / max(size, d)) ** 2, den + d
    r = layout.stress(round_, ring).first()
    assert r.pairs == 600 * 599 and abs(r.stress - num / den) < 1e-9
