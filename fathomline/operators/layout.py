"""Measures of a given layout: crossings, stress and how much of an area's hull its nodes span."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import checkpoints, kept
from fathomline.operators.keys import either_end

#: Points that a task hulls at once in the first round.
SALTS = 64

#: Edges of a block that a task compares with another block's.
BLOCK = 16_384

#: Links of a graph, from both ends, that a task may hold whole; beyond it distances are joined round by round.
WHOLE = 8_000_000

#: Groups that the sources of a graph are dealt to, and distances that one of them holds at once.
LANES, HELD = 64, 1 << 26


def _placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(e, a, b, ax, ay, bx, by): edges between placed nodes, numbered; loops and repeated edges stay, as each counts."""
    at = lambda end: nodes.select(F.col("node").alias(end), F.col("x").cast("double").alias(f"{end}x"), F.col("y").cast("double").alias(f"{end}y"))
    return edges.select("a", "b").withColumn("e", F.monotonically_increasing_id()).join(at("a"), "a").join(at("b"), "b")


def crossings(nodes: DataFrame, edges: DataFrame, blocks: int = 32) -> DataFrame:
    """One row (crossing, edges, fraction): pairs of edges that cross within both, without a common end, by the square of the number of edges.

    ``nodes`` are (node, x, y), ``edges`` (a, b). Edges are dealt to blocks and each pair of blocks is compared once, so every pair of edges is
    looked at once, in tasks of a bounded size; long edges made most pairs share the cells of a grid many times. The number of pairs is
    that of the square of the edges. No edges give a fraction of 0.
    """
    placed = kept(_placed(nodes, edges))
    m = placed.count()
    blocks = max(blocks, 1 + m // BLOCK)
    edge = placed.withColumn("block", F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int"))
    tasks = min(blocks * (blocks + 1) // 2, 1024)
    of = lambda meet: edge.withColumn("pair", F.explode(F.expr(meet))).drop("block").repartition(tasks, "pair")
    one = of(f"transform(sequence(block, {blocks - 1}), j -> block * {blocks} + j)")
    two = of(f"transform(sequence(0, block), i -> i * {blocks} + block)").select("pair", *(F.col(c).alias(f"{c}_") for c in ("e", "a", "b", "ax", "ay", "bx", "by")))
    side = lambda p, q, r: f"signum(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    own, other = (("ax", "ay"), ("bx", "by")), (("ax_", "ay_"), ("bx_", "by_"))
    apart = f"{side(*own, other[0])} * {side(*own, other[1])} < 0 AND {side(*other, own[0])} * {side(*other, own[1])} < 0"
    # in a block with itself each pair stands in both orders
    once = f"(pair DIV {blocks} <> pair % {blocks} OR e < e_)"
    met = one.join(two, "pair").where(f"{apart} AND a <> a_ AND a <> b_ AND b <> a_ AND b <> b_ AND {once}")
    return met.agg(F.count("*").alias("crossing")).select("crossing", F.lit(m).cast("long").alias("edges"), (F.col("crossing") / F.lit(max(m, 1) ** 2)).alias("fraction"))


def distances(edges: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(source, node, steps): graph distances from the sources (source), all nodes by default, up to ``most`` steps; each round joins only the nodes that the last one reached."""
    checkpoints(edges.sparkSession)
    both = either_end(edges.select("a", "b").where("a <> b")).select("node", "other").distinct().checkpoint()
    start = both.select(F.col("node").alias("source")).distinct() if sources is None else sources.select("source").distinct()
    seen = start.select("source", F.col("source").alias("node"), F.lit(0).alias("steps")).checkpoint()
    front, steps = seen, 0
    while most is None or steps < most:
        steps += 1
        found = front.join(both, "node").select("source", F.col("other").alias("node")).distinct()
        front = found.join(seen, ["source", "node"], "left_anti").withColumn("steps", F.lit(steps)).checkpoint()
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front).checkpoint()
    return seen


def _steps(others: np.ndarray, starts: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Graph distances (node, source), 0 where none leads there: each round passes on, as bits, which sources reached a node first in the last one."""
    n, words = len(starts), -(-len(sources) // 64)
    front = np.zeros((n, words * 8), np.uint8)
    at = np.arange(len(sources))
    np.bitwise_or.at(front, (sources, at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
    front = front.view(np.uint64)
    seen, found, steps = front.copy(), np.zeros((n, len(sources)), np.uint8), 0
    ends, part = np.append(starts, len(others)), max(1, n // 16)
    while front.any():
        steps += 1
        if steps == 256:
            found = found.astype(np.uint32)
        new = np.empty_like(front)
        for i in range(0, n, part):
            j = min(i + part, n)
            new[i:j] = np.bitwise_or.reduceat(front[others[ends[i]:ends[j]]], starts[i:j] - ends[i], axis=0) & ~seen[i:j]
            if new[i:j].any():
                found[i:j] += np.unpackbits(new[i:j].view(np.uint8), axis=1, count=len(sources), bitorder="little") * found.dtype.type(steps)
        seen |= new
        front = new
    return found


def _lane_stress(graph: pa.Table) -> pa.Table:
    """(pairs, part, steps): the sums over pairs whose source is the lane's own, from the whole graph's (node, others, places, own)."""
    graph = graph.combine_chunks()
    array = lambda c: graph[c].chunk(0)
    node, links, places = array("node"), array("others"), array("places")
    starts = np.append(0, np.cumsum(pc.list_value_length(links).to_numpy(zero_copy_only=False)))[:-1].astype(np.int64)
    others = pc.index_in(links.flatten(), value_set=node).to_numpy(zero_copy_only=False)
    of, place = pc.list_parent_indices(places).to_numpy(zero_copy_only=False).astype(np.int64), places.flatten()
    known = pc.and_(pc.is_valid(place.field("x")), pc.is_valid(place.field("y"))).to_numpy(zero_copy_only=False)
    x, y = (pc.fill_null(place.field(c), 0.0).to_numpy(zero_copy_only=False) for c in "xy")
    mine = np.flatnonzero(array("own").to_numpy(zero_copy_only=False)[of])
    width = max(64, min(1024, HELD // max(len(starts), 1)) // 64 * 64)
    pairs, part, weight, tall = 0, 0.0, 0, max(1, (1 << 17) // width)
    for k in range(0, len(mine), width):
        own = mine[k:k + width]
        found = _steps(others, starts, of[own])
        for i in range(0, len(of), tall):
            j = min(i + tall, len(of))
            d = found[of[i:j]].astype(np.float64)
            size = np.sqrt(np.square(x[i:j, None] - x[own]) + np.square(y[i:j, None] - y[own]))
            ratio = np.square((size - d) / np.maximum(np.maximum(size, d), 1e-9)) * d
            pairs, weight = pairs + int(np.count_nonzero(d)), weight + int(d.sum())
            part += float(ratio.sum(where=(d > 0) & known[i:j, None] & known[own]))
    return pa.table({"pairs": pa.array([pairs], pa.int64()), "part": pa.array([part], pa.float64()), "steps": pa.array([weight], pa.int64())})


def _joined_stress(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(pairs, part, steps) over the pairs themselves, which are joined round by round and written down."""
    far = distances(edges, sources).where("steps > 0")
    if sources is not None:
        far = far.join(sources.select(F.col("source").alias("node")).distinct(), "node", "left_semi")
    at = lambda end, n: nodes.select(F.col("node").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    both = far.join(at("source", 1), "source").join(at("node", 2), "node").withColumn("l", F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)))
    part = F.pow((F.col("l") - F.col("steps")) / F.greatest("l", "steps", F.lit(1e-9)), 2) * F.col("steps")
    return both.select(F.lit(1).alias("pairs"), part.alias("part"), "steps")


def stress(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row (pairs, stress): over pairs that the graph joins, the square of the relative difference of place distance and graph
    distance, weighted by the latter; each pair counts from both sides. ``sources`` (source) limits it to pairs of these; 0 without pairs.

    All pairs are looked at, so the time grows with their number, but none is written down: the sources are dealt to lanes, each gets the graph of
    at most ``WHOLE`` links and sums up over its own sources. A larger graph is joined round by round.
    """
    both = kept(either_end(edges.select("a", "b").where("a <> b")).select("node", "other").distinct())
    if both.count() > WHOLE:
        sums = _joined_stress(nodes, edges, sources)
    else:
        placed = nodes.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        if sources is not None:
            placed = placed.join(sources.select(F.col("source").alias("node")).distinct(), "node", "left_semi")
        places = placed.groupBy("node").agg(F.collect_list(F.struct("x", "y")).alias("places"))
        graph = both.groupBy("node").agg(F.collect_list("other").alias("others")).join(places, "node", "left").withColumn("places", F.coalesce("places", F.array()))
        lanes = graph.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))).withColumn("own", F.pmod(F.xxhash64("node"), F.lit(LANES)) == F.col("lane"))
        sums = lanes.repartition(LANES, "lane").groupBy("lane").applyInArrow(_lane_stress, "pairs long, part double, steps long")
    return sums.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("part") / F.nullif(F.sum("steps"), F.lit(0)), F.lit(0.0)).alias("stress"))


def _hull(points: pd.DataFrame) -> pd.DataFrame:
    """The corners of the convex hull, counter-clockwise."""
    at = sorted(set(zip(points.x, points.y, strict=True)))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out = []
    for way in (at, at[::-1]):
        half: list = []
        for p in way:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        out += half[:-1] if len(at) > 1 else half[: not out]
    made = pd.DataFrame(out, columns=["x", "y"])
    made.insert(0, "i", range(len(made)))
    made.insert(0, "grp", points.grp.iloc[0])
    return made


def hulls(points: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """(group, corners, area): convex hulls of each group's points. Parts of a group are hulled first and only their corners meet, so
    a large group is never in one task. Fewer than three corners have no area; points without a place are left out."""
    given = points.select(F.col(group).alias("grp"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    kind = dict(given.dtypes)["grp"]
    schema = f"grp {kind}, i long, x double, y double"
    first = given.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS))).groupBy("grp", "part").applyInPandas(lambda p: _hull(p), schema)
    last = first.groupBy("grp").applyInPandas(lambda p: _hull(p), schema)
    ring = last.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    area = F.expr("aggregate(sequence(1, size(r)), 0.0D, (a, i) -> a + r[i - 1].x * r[i % size(r)].y - r[i % size(r)].x * r[i - 1].y) / 2")
    corners: Column = F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ring.select(F.col("grp").alias(group), corners.alias("corners"), area.alias("area"))
