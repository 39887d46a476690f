"""SuperMinHash near-duplicate classes: banded signatures, verification on whole sets, components.

Each shingle draws a permutation of the signature's places. Its value at a place is the place's
rank in that permutation plus a fraction, and a signature holds the least value of all shingles at
each place. Since one shingle can't be low everywhere, the places depend on each other and the share
of equal places varies less than with independent hashes. Ranks are dealt in order, all shingles of
some texts at once: a text is done when its largest value is below the next rank, which for long
texts is after the first few.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.alike import alike, first_in_common, row_key, sets_of
from fathomline.llm.common import arrow_rows, small, written
from fathomline.llm.components import components, merged
from fathomline.llm.shingles import node_of, shingle_set

#: Bands of places. Texts alike by 0.85 share a band with a probability of 1 - 1e-8.
BANDS, ROWS = 48, 7
#: Places of a signature: a prime, so that every (start, step) walks through all of them.
PLACES = 337
#: Of the signature's last bits, so many make a sketch: at 0.85 they agree in 0.925 of cases.
BITS = 320
#: Fewer agreeing bits than so many are 6 standard deviations under what 0.85 gives.
AGREEING = 267
#: In a bucket of more nodes of different classes, pairs must also meet on a first shingle in common.
CROWD = 16
#: Shingles and texts that are held at once.
HELD, TEXTS = 1 << 17, 256
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _deal(held: np.ndarray, of: np.ndarray, least: np.ndarray) -> None:
    """Lower ``least`` (texts x PLACES) by the shingles ``held`` of the texts ``of``."""
    drawn = mixed(held, 1)
    place = ((drawn >> np.uint64(32)) % np.uint64(PLACES)).astype(np.int64)
    step = ((drawn & np.uint64(0xFFFFFFFF)) % np.uint64(PLACES - 1)).astype(np.int64) + 1
    flat = least.reshape(-1)
    for rank in range(PLACES):
        value = (mixed(held, rank + 2) >> np.uint64(32)) | np.uint64(rank << 32)
        np.minimum.at(flat, of * PLACES + place, value)
        open_ = least.max(axis=1) >= np.uint64((rank + 1) << 32)
        if not open_.any():
            return
        stay = open_[of]
        if not stay.all():
            held, of, place, step = held[stay], of[stay], place[stay], step[stay]
        place += step
        place[place >= PLACES] -= PLACES


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PLACES values for each shingle set; an empty set has the largest value everywhere."""
    least = np.full((len(sets), PLACES), FAR)
    at = 0
    while at < len(sets):
        upto, n = at + 1, len(sets[at])
        while upto < len(sets) and n + len(sets[upto]) <= HELD:
            n += len(sets[upto])
            upto += 1
        held = np.concatenate(sets[at:upto])
        of = np.repeat(np.arange(upto - at), [len(s) for s in sets[at:upto]])
        for k in range(0, len(held), HELD):  # a text of more shingles comes in parts
            _deal(held[k : k + HELD], of[k : k + HELD], least[at:upto])
        at = upto
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys a row."""
    places = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.zeros(places.shape[:2], np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ places[:, :, k], k + 1)
    return mixed(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 9)


def bit_sketch(least: np.ndarray) -> np.ndarray:
    """The last bits of the first places, in words of 64."""
    return np.packbits((least[:, :BITS] & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, rk, n, node, keys and sketch of each row; the sizes of sets and no keys for texts without a word."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), row_key().alias("rk"))

    def run(batches):
        for b in batches:
            texts = b["text"]
            for lo in range(0, len(texts), TEXTS):
                held = [shingle_set(t, words) for t in texts[lo : lo + TEXTS]]
                least = signatures(held)
                keys, bits = band_keys(least).view("<i8"), bit_sketch(least)
                yield {
                    "doc_id": b["doc_id"][lo : lo + TEXTS], "rk": b["rk"][lo : lo + TEXTS],
                    "n": [len(h) for h in held], "node": [node_of(h) if len(h) else None for h in held],
                    "keys": [k if len(h) else None for k, h in zip(keys, held, strict=True)],
                    "sketch": [k if len(h) else None for k, h in zip(bits, held, strict=True)],
                }

    return arrow_rows(raw, "doc_id long, rk long, n long, node long, keys array<long>, sketch array<long>", run)


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of different labels that share a band and may be alike by their sizes."""
    x = rows.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = rows.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    return x.join(y, "key").where(f"a < b AND la <> lb AND 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()


def _by_sketch(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sketches agree in as many bits as texts that are alike do."""
    known = nodes.select("node", "sketch")
    x = known.join(small(pairs), F.col("node") == F.col("a")).select("a", "b", F.col("sketch").alias("x"))
    both = known.join(x, F.col("node") == F.col("b")).withColumnRenamed("sketch", "y")
    agree = " + ".join(f"bit_count(x[{k}] ^ y[{k}])" for k in range(BITS // 64))
    return both.where(f"{BITS} - ({agree}) >= {AGREEING}").select("a", "b")


def _to_heaviest(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the heaviest node of a bucket, the one that it meets so in most buckets.

    A text from which others were made shares more bands with them than they do with each other, so a
    crowd of copies folds into one class with a pair for each.
    """
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    rows = shared.join(weight.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select("key", "node", "n", "weight")
    hubs = rows.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    met = rows.join(hubs, "key").where(f"node <> hub.node AND 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    best = met.groupBy("node", F.col("hub.node").alias("h")).agg(F.count("*").alias("c")).groupBy("node").agg(
        F.max_by("h", F.struct("c", "h")).alias("h"))
    return best.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct()


def _apart(docs: DataFrame, rest: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): pairs of different classes that share a band; in crowded buckets, those that also meet on a first shingle in common."""
    crowds = rest.groupBy("key").agg(F.count("*").alias("c")).where(f"c > {CROWD}").select(F.col("key").alias("k"))
    crowd = rest.join(crowds, F.col("key") == F.col("k"), "left_semi").select(F.col("node").alias("e"), F.col("n").alias("size"), "label").distinct()
    few = rest.join(crowds, F.col("key") == F.col("k"), "left_anti")
    return _met(few, percent).unionAll(first_in_common(docs, named, written(crowd, "crowds"), words, percent)).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link whose sets of distinct word shingles have 100 * intersection >= percent * union; every link is
    confirmed on the whole sets. Copies fold into one node first. In each band bucket a node is compared with
    the heaviest one; then all pairs of a bucket that are still in different classes are compared, but for those that
    sizes or the places of shared shingles rule out. Only the chance of meeting in no band (1e-8 at 0.85, less above) and of a sketch 6 deviations off
    can lose a link; at percentages under 85 both grow.

    Fewer words than a shingle make one shingle; null texts and texts without words have no shingles and link with nothing.
    Rows that repeat a doc_id each stand for themselves. A null doc_id keeps its row; its component is the
    smallest non-null id of its class, or null. An empty table gives no rows; further columns are ignored.
    """
    marked = written(_marked(docs, words), "signatures")
    nodes = written(
        marked.where("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("least_id"), F.min("rk").alias("rk"), F.first("n").alias("n"),
            F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high")).where(
        "size > 1").select(F.col("key").alias("k"), "size", "low", "high")
    shared = written(rows.join(full, F.col("key") == F.col("k")).select("key", "node", "n", "size"), "buckets")
    named = nodes.select("node", "rk")
    pairs = written(_by_sketch(_to_heaviest(shared, percent), nodes), "pairs")
    linked = written(alike(pairs, sets_of(docs, named, pairs, words), percent), "links")
    labels = written(components(linked), "classes")
    classed = shared.join(small(labels.withColumnRenamed("node", "j")), F.col("node") == F.col("j"), "left").select(
        "key", "node", "n", F.coalesce("label", "node").alias("label"))
    apart = classed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("key").alias("k"))
    rest = written(classed.join(apart, F.col("key") == F.col("k"), "left_semi"), "apart")
    left = written(_apart(docs, rest, named, words, percent).join(small(pairs), ["a", "b"], "left_anti"), "met")
    left = written(_by_sketch(left, nodes), "pairs")
    found = written(alike(left, sets_of(docs, named, left, words), percent), "links")
    joined = merged(labels, found)
    rooted = nodes.select("node", "least_id").join(joined.withColumnRenamed("node", "j"), F.col("node") == F.col("j"), "left").select(
        F.col("node").alias("of"), F.coalesce("label", "node").alias("root"), "least_id")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("least"))
    of_class = rooted.join(least, "root").select("of", "least")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return marked.join(of_class, F.col("node") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), d AS (SELECT doc_id, s, len(s) AS n FROM s),
g AS (SELECT list_sort(s) AS s, min(doc_id) AS id, any_value(n) AS n FROM d WHERE n > 0 GROUP BY 1),
m AS (
  SELECT a.id AS a, b.id AS b, a.n + b.n AS both_, len(list_intersect(a.s, b.s)) AS common
  FROM g a JOIN g b ON a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), e AS (SELECT a, b FROM m WHERE 100 * common >= 85 * (both_ - common)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles,
  CASE WHEN d.n = 0 THEN d.doc_id ELSE least(g.id, coalesce(l.b, g.id)) END AS component_id,
  d.doc_id = CASE WHEN d.n = 0 THEN d.doc_id ELSE least(g.id, coalesce(l.b, g.id)) END AS kept
FROM d LEFT JOIN g ON list_sort(d.s) = g.s LEFT JOIN least_id l ON l.a = g.id
"""
