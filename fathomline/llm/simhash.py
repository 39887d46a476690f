"""SimHash near-duplicate classes found by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``radius`` differing bits have a common point within half the
radius of each. Every distinct fingerprint therefore emits all its variants within that half;
fingerprints that meet on a variant are checked and linked. Members of one variant's bucket are
all within the radius of each other, so neighbours in sorted order link the whole bucket and
no list of pairs is made. A bucket holds at most as many distinct fingerprints as the ball has
points, whatever the number of documents: copies are folded into one fingerprint first.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.alike import HELD, alike, row_key, sets_of
from fathomline.llm.common import arrow_rows, small, written
from fathomline.llm.components import components, merged
from fathomline.llm.shingles import node_of, shingle_hashes, shingle_set

def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the word shingles."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += bit_counts(h)
        n += len(h)
    return majority(ones, n)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; null and empty texts give zero."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b["text"]], "<u8").view("<i8")
            yield {"doc_id": b["doc_id"], "fp": found.tolist()}

    return arrow_rows(raw, "doc_id long, fp long", run)


def ball(column: str, half: int) -> F.Column:
    """All values within ``half`` bits of the column, as an array."""
    masks = [0] + [sum(1 << i for i in c) for n in range(1, half + 1) for c in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.expr("transform(array({}), m -> {} ^ m)".format(", ".join(
        f"{m}L" if m != -(1 << 63) else "(-9223372036854775807L - 1L)" for m in signed), column))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct ``fp`` rows -> edges (a, b) that connect all fingerprints within the radius."""
    half = (radius + 1) // 2
    if radius % 2:
        raise ValueError("an even radius lets neighbours in a bucket stand for all its pairs")
    met = Window.partitionBy("variant").orderBy("fp")
    return (
        fps.select("fp", F.explode(ball("fp", half)).alias("variant"))
        .withColumn("before", F.lag("fp").over(met))
        .where(F.expr(f"before IS NOT NULL AND bit_count(fp ^ before) <= {radius}"))
        .select(F.col("before").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (hex), component_id, n_same.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing
    bits. Null and empty texts share fingerprint zero and link like others. A repeated doc_id
    gives a row each time. A null doc_id keeps its row; its component is the smallest non-null
    id of its class, or null. An empty table gives no rows; further columns are ignored.
    """
    marked = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_same")), "classes"
    )
    joined = components(links(classes.select("fp"), radius))
    rooted = classes.join(joined, classes.fp == joined.node, "left").withColumn("root", F.coalesce("label", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id", "n_same")
    return marked.join(of_class, marked.fp == of_class.f).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same"
    )


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


# Similarity classes: fingerprints that meet in a ball first, then, exactly, by first shingles.

#: One document in so many tells which shingles are common; their order decides the work and never the result.
DRAWN = 32
#: Places of the table of common shingles, of one byte each. Shingles that share a place share its level.
LEVELS = 1 << 20
#: Words of 64 bits in which each shingle of a set marks one bit.
MARKS = [f"m{i}" for i in range(8)]


def _common_levels(raw: DataFrame, words: int) -> bytes:
    """How common the shingles of each place are, as a power of two of the drawn documents that hold one."""
    drawn = raw.where(F.pmod(F.xxhash64("text"), F.lit(DRAWN)) == 0)

    def run(batches):
        for b in batches:
            yield {"keys": [shingle_set(t, words).view("<i8") for t in b["text"]]}

    counts = arrow_rows(drawn.select("text"), "keys array<long>", run).select(F.explode("keys").alias("key")).groupBy("key").count()
    level = F.floor(F.log2("count")).cast("int")
    places = counts.where("count > 2").groupBy(F.expr(f"key & {LEVELS - 1}L").alias("place")).agg(F.max(level).alias("level"))
    found = np.zeros(LEVELS, np.uint8)
    for r in places.toLocalIterator():  # at most LEVELS rows
        found[r.place] = r.level
    return found.tobytes()


def prefix(held: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets that are alike enough have one of them in common."""
    n = len(held)
    order = np.lexsort((held, levels[(held & np.uint64(LEVELS - 1)).astype(np.int64)]))
    return held[order[: n - _least_common(n, similarity) + 1]] if n else held


def marks(held: np.ndarray) -> list[int]:
    """A bit for each shingle, in signed 64-bit words: a bit that another set lacks is a shingle that it lacks."""
    bits = np.zeros(64 * len(MARKS), np.uint8)
    bits[((held >> np.uint64(40)) % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def _least_common(n: int, similarity: float) -> int:
    """Shingles that a set of n has in common with any set alike enough."""
    return ceil(similarity * n - 1e-9)


def _buckets(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, at, weight): first shingles that several nodes hold, and their place in the order of each.

    Of two sets alike enough, the smaller has its first common shingle among a smaller part of its first
    ones; a bucket where no node has the shingle so early joins nothing. ``weight`` sums the sizes of a node's buckets. A text from which others were made holds only
    shingles that they hold as well, so it weighs more than its copies.
    """
    share = similarity / (1 + similarity)
    rows = nodes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    held = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("both"), F.expr("min(n - at)").alias("after"),
        F.expr(f"min(at - {(1 - similarity) / (1 + similarity)!r}D * n) <= 1e-6D").alias("early"),
    ).where(f"size > 1 AND early AND (size > 2 OR after >= {share!r}D * both - 1e-6D)").select(F.col("key").alias("k"), "size", "least", "most")
    # a row stays if some partner of the bucket's sizes would do
    fits = F.expr(f"n - at >= {share!r}D * (n + greatest(least, {similarity!r}D * n)) - 1e-6D AND most >= {similarity!r}D * n - 1e-6D AND n >= {similarity!r}D * least - 1e-6D")
    shared = written(rows.join(held, F.col("key") == F.col("k")).where(fits).select("key", "node", "n", "at", "size"), "shared")
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight")).join(
        nodes.select(F.col("node").alias("m"), *MARKS), F.col("node") == F.col("m")).select("m", "weight", *MARKS)
    return written(shared.join(weights, F.col("node") == F.col("m")).select("key", "node", "n", "at", "weight", *MARKS), "buckets")


def _side(rows: DataFrame, end: str) -> DataFrame:
    """The rows as one end of a pair: node, n, at, label and marks get the end's name."""
    named = {"node": end, "n": f"n{end}", "at": f"at_{end}", "label": f"l{end}"} | {m: f"{end}_{m}" for m in MARKS}
    return rows.select("key", *(F.col(c).alias(n) for c, n in named.items()))


def _fits(similarity: float) -> F.Column:
    """Whether ends a and b can be alike if their places are those of the first shingle in common: what stands
    before them is not in common, nor is what marks a bit that the other lacks."""
    lacks = lambda x, y: " + ".join(f"bit_count({x}_{m} & ~{y}_{m})" for m in MARKS)
    common = f"({similarity / (1 + similarity)!r}D * (na + nb) - 1e-6D)"
    return F.expr(
        f"a <> b AND la <> lb AND least(na - at_a, nb - at_b) >= {common} AND na - ({lacks('a', 'b')}) >= {common} AND nb - ({lacks('b', 'a')}) >= {common}"
    )


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets with the class of each node, where a bucket holds several classes."""
    of = small(labels.withColumnRenamed("node", "j"))
    rows = shared.join(of, F.col("node") == F.col("j"), "left").withColumn("label", F.coalesce("label", "node")).drop("j")
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return rows.join(mixed.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi")


def _to_heaviest(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each node with the node, heaviest of a bucket, that it meets in most buckets."""
    rows = shared.withColumn("label", F.col("node"))
    hub = F.max(F.struct("weight", "node", "label", "n", "at", *MARKS)).alias("hub")
    hubs = _side(rows.groupBy("key").agg(hub).select("key", "hub.*"), "b")
    met = _side(rows, "a").join(hubs, "key").where(_fits(similarity)).groupBy("a", "b").agg(F.count("*").alias("c"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of different classes that can be alike.

    With rare shingles first, a crowd that shares a passage meets late, and so makes no pairs.
    """
    return _side(rows, "a").join(_side(rows, "b"), "key").where("a < b").where(_fits(similarity)).select("a", "b").distinct()


def similarity_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, component_id): classes of texts linked by a Jaccard similarity of their word shingles of ``similarity`` or more.

    Exact up to equal 64-bit hashes, in three steps over distinct shingle sets. (1) SimHash
    fingerprints meet in balls of half the radius; colliding pairs are checked by their sets. A
    similarity of 0.8 is about 10 of 64 bits, too far for any ball that can be emitted, so (2) nodes also meet
    on their first shingles in one order of all shingles, rare ones first: sets that are alike
    enough have one of these in common. Each node is compared with the heaviest of a bucket, so a crowd around one
    text folds into a class with a pair for each member. (3) All pairs of a bucket that are still in different classes
    and can be alike by their sizes, places and marks are compared, so none is left out.
    Nulls, empty texts, repeated rows and empty tables behave as in near_duplicates.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), row_key().alias("rk"))
    percent = round(100 * similarity)
    levels = _common_levels(raw, words)

    def run(batches):
        table = np.frombuffer(levels, np.uint8)
        for b in batches:
            for lo in range(0, len(b["text"]), HELD):
                held = [shingle_set(t, words) for t in b["text"][lo : lo + HELD]]
                bits = [marks(h) for h in held]
                yield {
                    "doc_id": b["doc_id"][lo : lo + HELD], "rk": b["rk"][lo : lo + HELD], "n": [len(h) for h in held], "node": [node_of(h) for h in held],
                    "fp": [int(np.int64(np.uint64(majority(bit_counts(h), len(h))).view(np.int64))) for h in held],
                    "keys": [prefix(h, table, similarity).view("<i8") for h in held],
                } | {m: [x[k] for x in bits] for k, m in enumerate(MARKS)}

    columns = "doc_id long, rk long, n long, node long, fp long, keys array<long>" + "".join(f", {m} long" for m in MARKS)
    marked = written(arrow_rows(raw, columns, run), "prefixes")
    nodes = written(marked.groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min("rk").alias("rk"), F.max("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"),
        *(F.first(m).alias(m) for m in MARKS)), "nodes")
    shared = _buckets(nodes, similarity)
    sample = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    same = nodes.select("node", "fp").join(sample.select(F.col("fp").alias("f"), F.col("node").alias("a")), F.col("fp") == F.col("f")).where("node <> a")
    ball_pairs = written(same.select("a", F.col("node").alias("b")).unionAll(links(nodes.select("fp").distinct(), radius).join(
        sample.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(
        sample.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct(), "balls")
    named = nodes.select("node", "rk")
    pairs = written(ball_pairs.unionAll(_to_heaviest(shared, similarity)).distinct(), "pairs")
    linked = written(alike(pairs, sets_of(docs, named, pairs, words), percent), "links")
    labels = written(components(linked), "classes")
    apart = written(_labelled(shared, labels), "apart")
    left = written(_possible(apart, similarity).join(small(pairs), ["a", "b"], "left_anti"), "pairs")
    found = written(alike(left, sets_of(docs, named, left, words), percent), "links")
    joined = merged(labels, found)
    rooted = nodes.select("node", "least_id").join(joined.withColumnRenamed("node", "j"), F.col("node") == F.col("j"), "left").select(
        F.col("node").alias("of"), F.coalesce("label", "node").alias("root"), "least_id")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = rooted.join(least, "root").select("of", "component_id")
    return marked.join(of_class, F.col("node") == F.col("of")).select("doc_id", "component_id")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its similarity class."""
    kept = similarity_classes(docs, words, similarity).where("doc_id <=> component_id").select(F.col("doc_id").alias("k")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.k), "left_semi").select(*docs.columns)
