"""Connected components of an edge table by min-label propagation with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) rows -> (node, label), label being the smallest node reachable.

    Each round takes the least label among the neighbours, then follows every label to its own
    label, so chains shorten geometrically. The rounds stop when a pass changes nothing. Labels
    live in written tables; only a count of changes reaches the driver. An empty edge table
    gives an empty result; null ends are ignored.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("n"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, labels.node == near.n).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("far"))
        jumped = written(
            stepped.join(target, stepped.label == target.t).select(
                "node", "old", F.least("label", "far").alias("label")
            ),
            "labels",
        )
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (node, label) after further edges (a, b): components of the classes only, which are few, and one join.

    A node that no label names is a class of its own; nodes without any edge stay out.
    """
    of = lambda end: labels.select(F.col("node").alias(f"n{end}"), F.col("label").alias(f"l{end}"))
    contracted = more.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    above = components(contracted).select(F.col("node").alias("class"), F.col("label").alias("root"))
    new = above.join(labels, F.col("class") == F.col("node"), "left_anti").select(F.col("class").alias("node"), F.col("root").alias("label"))
    old = labels.join(above, F.col("label") == F.col("class"), "left").select("node", F.coalesce("root", "label").alias("label"))
    return old.unionAll(new)
