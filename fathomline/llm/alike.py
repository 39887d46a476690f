"""Verification of candidate pairs by whole shingle sets, for texts that are named by their set.

Rows are found again by a key of their own, made of id and text, so null and repeated ids need no
treatment. Sketches go first; sets follow for the pairs that these can't rule out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows, small, written
from fathomline.llm.shingles import may_be_alike, shingle_set, sketch

ROW_KEY = "rk"
#: Texts whose sets a task holds at once.
HELD = 256


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of id and text; rows that share it are taken for repeated rows."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node, rk) in ``wanted`` (e)."""
    found = written(nodes.join(wanted, F.col("node") == F.col("e"), "left_semi").select("node", ROW_KEY), "wanted")
    texts = docs.select(row_key().alias("k"), F.col("text").cast("binary").alias("text"))
    return texts.join(small(found), F.col("k") == F.col(ROW_KEY)).select("node", "text")


def first_in_common(docs: DataFrame, nodes: DataFrame, crowd: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): nodes of the crowd (e, size, label) of different labels that may be alike by the first shingle in common.

    Shingles are ordered by how many of the crowd hold them, rare ones first. Two sets that are alike enough have one in common
    among the first ``100 - percent`` in a hundred of either, and what stands before it in either isn't in common. So texts
    that were each changed in places of their own make no pairs, however many there are. No pair that is alike is left out.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, len(b["text"]), HELD):
                yield {"n": b["node"][lo : lo + HELD], "held": [shingle_set(t, words).view("<i8") for t in b["text"][lo : lo + HELD]]}

    rows = arrow_rows(texts_of(docs, nodes, crowd.select("e")), "n long, held array<long>", run).dropDuplicates(["n"])
    rows = written(rows.join(small(crowd), F.col("n") == F.col("e")).select("n", "size", "label", F.explode("held").alias("shingle")), "crowd")
    held = rows.groupBy("shingle").agg(F.count("*").alias("c"))
    order = Window.partitionBy("n").orderBy("c", "shingle")
    placed = rows.join(held, "shingle").withColumn("at", F.row_number().over(order) - 1)
    first = written(placed.where(f"c > 1 AND 100 * at <= {100 - percent} * size").select("shingle", "n", "size", "label", "at"), "first")
    x = first.select("shingle", F.col("n").alias("a"), F.col("size").alias("na"), F.col("label").alias("la"), F.col("at").alias("at_a"))
    y = first.select("shingle", F.col("n").alias("b"), F.col("size").alias("nb"), F.col("label").alias("lb"), F.col("at").alias("at_b"))
    fits = f"a < b AND la <> lb AND {100 + percent} * least(na - at_a, nb - at_b) >= {percent} * (na + nb)"
    return x.join(y, "shingle").where(fits).select("a", "b").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(n, size, sketch, held): the shingle sets of the nodes (node, rk) in the pairs (a, b), each once."""
    given = texts_of(docs, nodes, pairs.select(F.col("a").alias("e")).unionAll(pairs.select("b")).distinct())

    def run(batches):
        done = set()  # repeated rows of a task give their set once
        for b in batches:
            for lo in range(0, len(b["text"]), HELD):
                held = []
                for n, t in zip(b["node"][lo : lo + HELD], b["text"][lo : lo + HELD], strict=True):
                    if n not in done:
                        done.add(n)
                        held.append((n, shingle_set(t, words)))
                yield {
                    "n": [n for n, _ in held], "size": [len(h) for _, h in held],
                    "sketch": [sketch(h) for _, h in held], "held": [h.tobytes() for _, h in held],
                }

    found = written(arrow_rows(given, "n long, size long, sketch binary, held binary", run), "sets")
    repeated = found.groupBy("n").count().where("count > 1").limit(1).count()
    return found.dropDuplicates(["n"]) if repeated else found


def _beside(pairs: DataFrame, sets: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    """(a, b) with columns of the sets of both ends, under a name for either end."""
    known = small(pairs)
    x = sets.join(known, F.col("n") == F.col("a")).select("a", "b", *(F.col(c).alias(v[0]) for c, v in named.items()))
    y = sets.join(known, F.col("n") == F.col("b")).select("a", "b", *(F.col(c).alias(v[1]) for c, v in named.items()))
    return x.join(y, ["a", "b"])


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union, in whole numbers."""

    def close(batches):
        for b in batches:
            keep = [i for i, v in enumerate(zip(b["x"], b["y"], b["nx"], b["ny"], strict=True)) if may_be_alike(*v, percent)]
            yield {"a": [b["a"][i] for i in keep], "b": [b["b"][i] for i in keep]}

    sketches = _beside(pairs, sets, {"sketch": ("x", "y"), "size": ("nx", "ny")})
    near = written(arrow_rows(sketches, "a long, b long", close), "close")
    both = _beside(near, sets, {"held": ("x", "y")})

    def compared(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                same = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * same >= percent * (len(p) + len(q) - same):
                    keep.append(i)
            yield {"a": [b["a"][i] for i in keep], "b": [b["b"][i] for i in keep]}

    return arrow_rows(both, "a long, b long", compared)
