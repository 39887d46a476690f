"""Periodic runs of words: suffix trees, constant-time extensions, Lyndon roots.

A run is a maximal stretch that repeats with its smallest period at least twice. Each run has a Lyndon
root under one of the two orders of the words, and the longest Lyndon word that starts at a place
ends at the next smaller suffix. So the places with their next smaller suffix under either order are
all the candidates there are; each is extended to the right by the longest common prefix of two
suffixes (lowest common ancestor in the suffix tree) and to the left by that of two suffixes of the
reversed text (its own tree). Trees are built by Ukkonen's algorithm; ancestors are range minima over an Euler tour.

Before that, stretches that can't hold a run are set aside: in a run of ``least`` words or more each word lies in
a window of ``least // 2`` words that occurs twice. What is left is cut where no such window reaches, and runs
never cross a cut, so the trees are built over the parts alone and the runs stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows

#: The least number of words of a run.
LEAST = 12


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers >= 0, with an end mark below all of them."""

    def __init__(self, words: list[int]):
        text = [*words, -1]
        n, base = len(text), max(words, default=0) + 2
        start, stop, link = [0], [0], [0]  # of the edge into each node; node 0 is the root
        child: dict[int, int] = {}  # node * base + first word + 1
        node, at, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(text):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    at = i
                key = node * base + text[at] + 1
                below = child.get(key)
                if below is None:
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    child[key] = len(start) - 1
                    if made:
                        link[made] = node
                    made = node
                else:
                    s = start[below]
                    size = min(stop[below], i + 1) - s
                    if length >= size:
                        at += size
                        length -= size
                        node = below
                        continue
                    if text[s + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    start.append(s)
                    stop.append(s + length)
                    link.append(0)
                    fork = len(start) - 1
                    child[key] = fork
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    child[fork * base + c + 1] = fork + 1
                    start[below] = s + length
                    child[fork * base + text[s + length] + 1] = below
                    if made:
                        link[made] = fork
                    made = fork
                waiting -= 1
                if not node and length:
                    length -= 1
                    at = i - waiting + 1
                elif node:
                    node = link[node]
        self.n = n
        keys = np.fromiter(child, np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        above, first = keys // base, keys % base
        edge = (np.array(stop) - np.array(start)).tolist()
        self.rank, depths = self._tour(above, first, below, edge)
        self._fork = (above, first, below, edge)
        self.table, width = [np.array(depths, np.int64)], 1
        while 2 * width <= len(depths):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def _tour(self, above: np.ndarray, by: np.ndarray, below: np.ndarray, edge: list[int]) -> tuple[np.ndarray, list[int]]:
        """The rank of each suffix, and the depth of the lowest common ancestor of each leaf and the one before it.

        Of the Euler tour between two leaves only the least depth is ever asked for, so one value a leaf is kept.
        """
        order = np.lexsort((by, above))
        above, kids = above[order], below[order].tolist()
        heads = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
        ends = np.r_[heads[1:], len(above)].tolist()
        held = {a: (s, e) for a, s, e in zip(above[heads].tolist(), heads.tolist(), ends, strict=True)}
        n, leaves, depths = self.n, [], []
        stack = [(0, 0, 0)]
        while stack:
            node, depth, shared = stack.pop()
            span = held.get(node)
            if span is None:
                leaves.append(n - depth)
                depths.append(shared)
                continue
            s, e = span
            for k in range(e - 1, s, -1):
                stack.append((kids[k], depth + edge[kids[k]], depth))
            stack.append((kids[s], depth + edge[kids[s]], shared))
        rank = np.empty(n, np.int64)
        rank[leaves] = np.arange(n)
        return rank, depths[1:]

    def turned(self) -> np.ndarray:
        """The rank of each suffix with the order of the words reversed; the end mark stays below all."""
        above, first, below, edge = self._fork
        return self._tour(above, np.where(first == 0, 0, int(first.max()) + 1 - first), below, edge)[0]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The lengths of the longest common prefixes of pairs of different suffixes, each in constant time."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            found[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return found


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the end mark, the place of the next one of a smaller rank."""
    ranks = rank.tolist()
    found, stack = [0] * (len(ranks) - 1), [len(ranks) - 1]
    for i in range(len(ranks) - 2, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        found[i] = stack[-1]
        stack.append(i)
    return np.array(found, np.int64)


def runs_of(words: list[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of ``least`` words or more, by start and period."""
    n = len(words)
    tree, turned = SuffixTree(words), SuffixTree(words[::-1])
    at = np.arange(n)
    i, j = np.r_[at, at], np.r_[next_smaller(tree.rank), next_smaller(tree.turned())]
    left, right = turned.common(n - i, n - j), tree.common(i, j)
    period, length = j - i, j - i + left + right
    keep = (length >= 2 * period) & (length >= least)
    found = np.unique(np.stack([i - left, period, length], axis=1)[keep], axis=0)
    return found[:, [0, 2, 1]]


def parts(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the stretches that may hold runs; no run of ``least`` words crosses their ends.

    A run of L words and period q repeats its first L - q words q places on, and L - q is ``least // 2`` at least,
    so windows of that width that occur twice cover it. Windows are told apart by 64 bits; equal bits of
    different windows keep a stretch that needn't be kept and change nothing else.
    """
    width = least // 2
    at = np.arange(len(hashes))
    while True:
        if len(at) < least:
            return []
        part = np.cumsum(np.r_[0, np.diff(at) != 1]).astype(np.uint64)
        key = part[: len(at) - width + 1] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(width):
            key = (key ^ hashes[at[k : len(at) - width + 1 + k]]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(29)
        whole = np.flatnonzero(part[: len(at) - width + 1] == part[width - 1 :])
        order = np.argsort(key[whole])
        ranked = key[whole][order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        stay = np.zeros(len(at), bool)
        for k in range(width):
            stay[whole[twice] + k] = True
        if stay.all():
            heads = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            ends = np.r_[heads[1:], len(at)]
            return [(int(at[s]), int(at[e - 1]) + 1) for s, e in zip(heads, ends, strict=True) if e - s >= least]
        at = at[stay]


def runs_in(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs among the words."""
    if len(words) < least:
        return []
    found = []
    for s, e in parts(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), least):
        known: dict[bytes, int] = {}
        numbers = [known.setdefault(w, len(known)) for w in words[s:e]]
        found += [(s + a, b, c) for a, b, c in runs_of(numbers, least).tolist()]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if found:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = LEAST, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period by start and period), collapsed (string).

    Words are what stands between spaces and the characters 09 to 0D. ``change`` may replace the words of a document first.
    Documents are independent of each other, so copies, repeated and null ids each give their row. Null and empty texts
    have no runs and an empty collapsed text; an empty table gives no rows; further columns are ignored. Time
    and memory grow in proportion to a text (about 0.5 KB for each word in the stretches that may hold runs).
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for lo in range(0, len(b["text"]), 256):
                ids, found, left = b["doc_id"][lo : lo + 256], [], []
                for doc_id, text in zip(ids, b["text"][lo : lo + 256], strict=True):
                    words = (text or b"").split()
                    if change:
                        words = change(doc_id, words)
                    held = runs_in(words, least)
                    found.append([{"start": x, "length": y, "period": z} for x, y, z in held])
                    left.append(collapsed(words, held).decode())
                yield {"doc_id": ids, "runs": found, "collapsed": left}

    return arrow_rows(raw, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string", run)


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the numbered query: a tenth of the ids get a periodic tail; a null id changes nothing."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + k % p] for k in range(n - a))]


def op12_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=made_periodic)
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384))) AS h
  FROM documents
), g AS (SELECT doc_id, w, len(w) AS n, h % 10 AS dealt, h // 10 AS g FROM d),
a AS (SELECT *, g % greatest(n, 1) AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (
  SELECT doc_id, n, CASE WHEN dealt = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM p
), six AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM t, unnest(range(0, n - 5)) AS u(i)
), met AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
), island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM met),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM island GROUP BY doc_id, q, k),
run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), summed AS (
  SELECT doc_id, count(*) AS n_runs, first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT t.doc_id, string_agg(t.w[i + 1], ' ' ORDER BY i) AS kept
  FROM t, unnest(range(0, n)) AS u(i) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = t.doc_id AND gone.i = u.i) GROUP BY t.doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
  1000 * best.l // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
