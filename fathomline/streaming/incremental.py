"""Resumable ingestion: checkpoints, an idempotent batch ledger and latest verdicts over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def drain(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, keys: list[str], files_per_batch: int = 100) -> None:
    """Take all new Parquet files of ``source`` once into ``sink`` and stop.

    Progress is in the checkpoint folder, so a later call reads only what came since. Each batch
    goes to its own folder ``batch=<id>`` by overwrite: one that is tried again replaces what it
    had written. Repeated keys within a batch are folded; ``settled`` folds them across batches.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def settled(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """One row per key over all batches, the newest batch's."""
    from fathomline.operators.keys import top_per_group

    return top_per_group(spark.read.parquet(sink), keys, [F.desc("batch")]).drop("batch")


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and time window; with a stream, windows close behind the watermark."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), key, "n")
    )


_LEDGER = "batch long, state string, taken long, turn long"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], _LEDGER)


def next_batch(spark: SparkSession, work: DataFrame, ledger: str) -> int | None:
    """The batch to go on with: first the one that was cut, longest ago first, then the smallest that was never begun."""
    last = _ledger(spark, ledger).groupBy("batch").agg(F.max_by("state", "turn").alias("state"), F.max("turn").alias("turn"))
    known = work.select("batch").distinct().join(last, "batch", "left").where("state IS NULL OR state = 'cut'")
    first = known.select(F.min(F.struct((F.col("state").isNull()).alias("fresh"), "turn", "batch")).alias("b")).first().b
    return None if first is None else first.batch


def run_batches(
    work: DataFrame, consume: Callable[[DataFrame], DataFrame], key: str, sink: str, ledger: str, budget: int, order: str | None = None
) -> list[tuple[int, str, int]]:
    """Work through the batches of ``work`` (``key``, batch, ...) until ``budget`` rows are taken; returns (batch, state, taken) of this call.

    A batch that the budget cuts is written down as ``cut`` and taken up first by the next call. Results go to ``sink`` and are told apart by
    ``key``: rows that it holds are never taken again, so a call that dies after writing and before its line in the ledger repeats nothing. The
    consumer gets the rows that fit and returns results that carry ``key``. The ledger only grows; a batch's last line counts.
    """
    spark, left, told = work.sparkSession, budget, []
    while left > 0:
        batch = next_batch(spark, work, ledger)
        if batch is None:
            break
        try:
            done = spark.read.parquet(sink).select(key)
        except AnalysisException:
            done = work.select(key).limit(0)
        rest = work.where(F.col("batch") == batch).join(done, key, "left_anti")
        open_ = rest.count()
        taken = min(open_, left)
        if taken:
            part = rest if taken == open_ else rest.orderBy(order or key).limit(taken)
            consume(part).write.mode("append").parquet(sink)
        state = "done" if taken == open_ else "cut"
        turn = (_ledger(spark, ledger).agg(F.max("turn")).first()[0] or 0) + 1
        spark.createDataFrame([(batch, state, taken, turn)], _LEDGER).coalesce(1).write.mode("append").parquet(ledger)
        left -= taken
        told.append((batch, state, taken))
    return told
