"""Incremental history: mergeable partial aggregates, and a stream of commits folded into a stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import _lines, prepare
from ..schema import COMMIT

_SUMS = ("commits", "adds", "dels")


def partial(changes: DataFrame) -> DataFrame:
    """Per path a state that merges: sums, and structs for the extremes by day."""
    dated = F.col("day") > 0
    return changes.groupBy("path").agg(
        F.count("*").alias("commits"), _lines("add").alias("adds"), _lines("del").alias("dels"),
        F.min(F.when(dated, F.struct("day", "seq", "hash"))).alias("born"), F.max(F.when(dated, F.struct("day", "seq", "key", "subject"))).alias("last"),
    )


def merge(state: DataFrame, more: DataFrame) -> DataFrame:
    """The state of both inputs together."""
    return state.unionByName(more).groupBy("path").agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("born").alias("born"), F.max("last").alias("last"))


def result(state: DataFrame) -> DataFrame:
    def day(c: str) -> Column:
        return F.coalesce(F.col(f"{c}.day"), F.lit(0)).cast("int")

    return state.select("path", *_SUMS, day("born").alias("first_day"), day("last").alias("last_day"), F.col("born.hash").alias("born_commit"), F.col("last.key").alias("last_author"), F.col("last.subject").alias("last_subject"))


def _state_path(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


def follow(spark: SparkSession, source: str, state: str, checkpoint: str, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Folds JSON commit files that arrive in `source` into per-path states below `state`.

    Each micro-batch writes its own partial aggregates to a folder of its number, so a
    batch that is run again replaces itself and nothing is counted twice.  Late and
    unordered commits merge by minima and maxima; no watermark drops any.
    """
    stream = spark.readStream.schema(COMMIT).json(source)

    def fold(batch: DataFrame, number: int) -> None:
        partial(prepare(batch)[1]).write.mode("overwrite").parquet(_state_path(state, number))

    w = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The merged state of all batches."""
    parts = spark.read.parquet(state)
    return parts.groupBy("path").agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("born").alias("born"), F.max("last").alias("last"))


def compact(spark: SparkSession, state: str, to: str) -> None:
    """Writes the merged state as one batch elsewhere, for when there are many small ones."""
    read_state(spark, state).write.mode("overwrite").parquet(_state_path(to, 0))


def mark_partial(summary: DataFrame, reason: str | None) -> DataFrame:
    """summary with partial and partial_reason: whether it covers only a part of the history, and why."""
    return summary.withColumn("partial", F.lit(reason is not None)).withColumn("partial_reason", F.lit(reason).cast("string"))
