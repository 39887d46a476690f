"""Weighted votes, hierarchy collapse, components and group graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.keys import either_end, top_per_group


def vote(direct: DataFrame, through: DataFrame, owner: str, area: str, direct_weight: float = 2.0) -> DataFrame:
    """(owner, area, total): 2 for a direct link plus weight x max(evidence, 1) of linked people."""
    votes = direct.select(owner, area, F.lit(direct_weight).alias("v")).unionByName(
        through.select(owner, area, (F.col("weight") * F.greatest("evidence", F.lit(1))).alias("v"))
    )
    return votes.groupBy(owner, area).agg(F.sum("v").alias("total"))


def primary(votes: DataFrame, owner: str, area: str, total: str = "total") -> DataFrame:
    """The area with the greatest total; ties go to the smaller area id."""
    return top_per_group(votes, owner, [F.desc(total), F.asc(area)])


def with_fallback(people: DataFrame, own: DataFrame, person: str, inherited: DataFrame, area: str) -> DataFrame:
    """(person, area, source): the own primary, else the inherited one."""
    a = own.select(person, F.col(area).alias("__own"))
    b = inherited.select(person, F.col(area).alias("__given"))
    return people.select(person).join(a, person, "left").join(b, person, "left").select(
        person, F.coalesce("__own", "__given").alias(area),
        F.when(F.col("__own").isNotNull(), "own").when(F.col("__given").isNotNull(), "inherited").alias("source"),
    )


def collapse_map(sizes: list[tuple], parents: dict, least: int) -> dict:
    """Where each group of a small vocabulary ends when groups under ``least`` join their parent.

    The smallest (size, id) goes first, sizes are carried upwards and chains are followed. A small
    group without a parent stays. The vocabulary has a fixed size, so this runs in the driver.
    """
    held, target = dict(sizes), {}
    while True:
        small = sorted((n, k) for k, n in held.items() if n < least and parents.get(k) is not None and parents[k] != k)
        if not small:
            break
        n, k = small[0]
        up = parents[k]
        del held[k]
        held[up] = held.get(up, 0) + n
        target[k] = up

    def end(k):
        seen = set()
        while k in target and k not in seen:
            seen.add(k)
            k = target[k]
        return k

    return {k: end(k) for k in {*dict(sizes), *target}}


def collapsed(assigned: DataFrame, area: str, parents: dict, least: int) -> DataFrame:
    """Assignments with small areas rolled into their parents."""
    sizes = [tuple(r) for r in assigned.groupBy(area).count().collect()]  # a row for each vocabulary entry
    ends = collapse_map(sizes, parents, least)
    rows = [(k, v) for k, v in ends.items() if k is not None]
    if not rows:
        return assigned
    table = assigned.sparkSession.createDataFrame(rows, f"__k {dict(assigned.dtypes)[area]}, __v {dict(assigned.dtypes)[area]}")
    return assigned.join(F.broadcast(table), F.col(area) == F.col("__k"), "left").withColumn(area, F.coalesce("__v", area)).drop("__k", "__v")


def checkpoints(spark: SparkSession) -> None:
    """Name the folder of checkpoints: the session's own, or in a local session a new one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not named:
        import tempfile

        named = tempfile.mkdtemp(prefix="fathomline-")
    context.setCheckpointDir(named)


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder of checkpoints, for rounds that build on one another.

    ``checkpoint()`` keeps what Spark knows of equal columns, which triples in each such round until planning takes minutes;
    a table read anew knows only its schema.
    """
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def roots(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth) by pointer jumping, for hierarchies of any depth.

    Each round doubles the reach of every pointer, and rounds go on while they settle nodes. Nodes that lead
    into a cycle have no root: they keep a node of the cycle and a null depth. A parent that is no node is the root.
    """
    checkpoints(nodes.sparkSession)
    top = F.col(parent).isNull() | (F.col(parent) == F.col(key))
    given = nodes.select(key, F.when(top, F.col(key)).otherwise(F.col(parent)).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done"))
    known = given.select(F.col(key).alias("__k"))
    at = given.join(known, F.col("root") == F.col("__k"), "left").withColumn("done", F.col("done") | F.col("__k").isNull()).drop("__k").checkpoint()
    left = at.where("NOT done").count()
    while left:
        up = at.select(F.col(key).alias("__k"), F.col("root").alias("__r"), F.col("depth").alias("__d"), F.col("done").alias("__s"))
        at = at.join(up, ~F.col("done") & (F.col("root") == F.col("__k")), "left").select(
            key, F.coalesce("__r", "root").alias("root"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"),
            (F.col("done") | F.coalesce("__s", F.lit(False))).alias("done")).checkpoint()
        now = at.where("NOT done").count()
        if now == left:
            break
        left = now
    return at.select(key, "root", F.when(F.col("done"), F.col("depth")).alias("depth"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by label propagation and pointer jumps until nothing changes.

    Each round is written down, so plans stay short and a lost executor costs one round. Edges are dealt to a number of tasks
    that grows with them.
    """
    from fathomline.operators.metrics import dealt

    given = kept(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))
    rows = 2 * given.count()
    both = kept(dealt(either_end(given), "node", "other", rows=rows).distinct())
    labels = kept(dealt(either_end(given), "node", rows=rows).groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    rows = both.count()
    while True:
        told = labels.select(F.col("node").alias("of"), F.col("component").alias("seen"))
        near = dealt(both, "other", rows=rows).join(told, F.col("other") == F.col("of")).groupBy(F.col("node").alias("n")).agg(F.min("seen").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        far = labels.select(F.col("node").alias("t"), F.col("component").alias("far"))
        moved = kept(stepped.join(far, F.col("mid") == F.col("t"), "left").select("node", "old", F.least("mid", "far").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("component <> old").limit(1).count() == 0:
            return labels


def supergraph(edges: DataFrame, groups: DataFrame, node: str, group: str) -> DataFrame:
    """Edge weights between groups: (ga, gb, weight) with ga <= gb."""
    a = groups.select(F.col(node).alias("__a"), F.col(group).alias("x"))
    b = groups.select(F.col(node).alias("__b"), F.col(group).alias("y"))
    joined = edges.join(a, edges.a == F.col("__a")).join(b, edges.b == F.col("__b"))
    return joined.groupBy(F.least("x", "y").alias("ga"), F.greatest("x", "y").alias("gb")).agg(F.sum("weight").alias("weight"))
