"""Frame helpers shared by the operators: ordering with global prefix sums, shared folders, groups of links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a broadcast side at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Links that one task joins up at most.
LAST_LINKS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors share.

    Where it is unset, a folder of its own on a local master, as in tests; a cluster has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="chronolith-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later steps survive lost executors without a recount."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows as a Parquet table in the shared folder.

    Unlike a checkpoint it carries neither size estimates nor constraints of the plan that made
    it, which multiply from round to round of an iteration.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def no_clash(names: Iterable[str], own: Iterable[str]) -> None:
    """Raises a ValueError if a column that is asked for has the name of one that the operator adds."""
    if both := {n.lower() for n in names} & {n.lower() for n in own}:
        raise ValueError(f"columns named like the operator's own have to be renamed first: {', '.join(sorted(both))}")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if `rows`, its counted size, is within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread_join(rows: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows left joined on `on` with side, a row a key, whose column `copies` says how many of the rows have the key (it is dropped).

    Keys of more than one in BROADCAST_ROWS of all copies are at most BROADCAST_ROWS, so they
    are broadcast and their rows stay where they are; no key of the others is large.
    """
    more = [c for c in side.columns if c not in (*on, "copies")]
    large = F.col("copies") * BROADCAST_ROWS > F.lit(side.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    first = rows.join(F.broadcast(side.where(large).drop("copies").withColumn("large", F.lit(True))), list(on), "left")
    rest = first.where("large is null").drop("large", *more).join(side.where(~large).drop("copies"), list(on), "left")
    return first.where("large").drop("large").unionByName(rest)


def ordered(df: DataFrame, keys: Sequence[Column], weight: str) -> DataFrame:
    """df in the order of `keys` with the columns `ord` (rows before) and `before` (sum of `weight` before).

    The rows are dealt out by range and sorted; each partition counts its own prefix
    sums, and only the partitions' totals are added up across partitions.  Rows with
    equal keys spread over neighbouring partitions as long as the keys end in a
    column that tells them apart.  The bounds of the ranges come from a first run over
    df, so what is dear to compute is better written before.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ("part", "ord", "before"))])
    at = df.columns.index(weight)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            w = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(w)
            added = [np.full(len(w), part), rows + np.arange(len(w)), total + sums - w]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in added)], names=[*b.schema.names, "part", "ord", "before"])
            rows, total = rows + len(w), total + int(sums[-1]) if len(w) else total

    held = cut(df.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys).mapInArrow(count, schema))
    totals = held.groupBy("part").agg(F.max(F.col("ord") + 1).alias("n"), F.max(F.col("before") + F.col(weight)).alias("w"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(w), F.lit(0)).alias("w0"))
    # a row a partition, so its size is bounded by the number of partitions
    return held.join(F.broadcast(bases), "part").select(*df.columns, (F.col("ord") + F.col("n0")).alias("ord"), (F.col("before") + F.col("w0")).alias("before"))


def components(edges: DataFrame, a: str, b: str, last: int = LAST_LINKS, report: list[int] | None = None) -> DataFrame:
    """Connected components of undirected links, as (node, component): the smallest node of each.

    Every round deals out new ranks by a hash of the node and the round.  A node moves to its
    neighbour of the lowest rank, if that is below its own, and on to where that one moves;
    links shrink to those between different nodes that are left.  As ranks are new each round,
    a fixed share of the nodes goes on the average whatever the form and the order of ids of
    the graph, and the rounds grow with the logarithm of the nodes (a test counts them).  A
    round writes two tables, which also keeps the plans of late rounds as small as those of the
    first.  Neighbour minima combine before the shuffle; the other joins are equi-joins of
    written tables, whose skewed partitions adaptive execution splits.  Once at most `last`
    links are left (a fixed number, whatever the input) one task joins them up.

    Null ends and links of a node with itself say nothing; no links give no rows.  `report`
    receives the number of links before each round.
    """
    kind = edges.schema[a].dataType
    pairs = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).where("u <> v")
    links = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    moves: list[DataFrame] = []
    while (left := links.count()) > last:
        if report is not None:
            report.append(left)
        rank = F.lit(len(moves))
        both = links.select("u", "v").union(links.select("v", "u")).toDF("n", "m")
        low = both.groupBy("n").agg(F.min(F.struct(F.xxhash64("m", rank).alias("r"), F.col("m").alias("p"))).alias("low"))
        up = low.select("n", F.least("low", F.struct(F.xxhash64("n", rank).alias("r"), F.col("n").alias("p")))["p"].alias("p"))
        up = written(up.join(up.select(F.col("n").alias("p"), F.col("p").alias("g")), "p").select("n", F.col("g").alias("p")), "moves")
        moves.append(up)
        moved = links.join(up.select(F.col("n").alias("u"), F.col("p").alias("pu")), "u").join(up.select(F.col("n").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv")
        links = written(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")
    found = _joined_up(links)
    if not moves:
        return found.select(F.col("n").alias("node"), F.col("p").alias("component"))
    for up in reversed(moves):
        found = _followed(up, found)
    # every node of a link is a row of `found`; p only names its component
    found = written(found, "found")
    return found.join(found.groupBy("p").agg(F.min("n").alias("component")), "p").select(F.col("n").alias("node"), "component")


def _followed(up: DataFrame, later: DataFrame) -> DataFrame:
    """Where each node of a round's moves (n, p) is in the end, by the places (n, p) of the nodes of later rounds."""
    to = later.select(F.col("n").alias("p"), F.col("p").alias("g"))
    return up.join(to, "p", "left").select("n", F.coalesce("g", "p").alias("p"))


def _joined_up(links: DataFrame) -> DataFrame:
    """(n, p) of every node of at most LAST_LINKS links: the smallest node that links reach."""
    schema = T.StructType([T.StructField(c, links.schema["u"].dataType) for c in ("n", "p")])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [pa.concat_arrays([x.column(j) for x in held]) for j in (0, 1)] if (held := [b for b in batches if b.num_rows]) else None
        if both is None:
            return
        kind = both[0].type
        names, at = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in both]), return_inverse=True)
        low = lowest_labels(len(names), *np.split(at.ravel(), 2))
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(names[low], kind)], names=["n", "p"])

    return links.coalesce(1).mapInArrow(go, schema)


def lowest_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest that the links (u, v) reach; every pass halves the distance at least."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v, label[u], label[v]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
def arrow_strings(b: pa.RecordBatch, name: str) -> pa.Array:
    return pc.cast(b.column(name), pa.large_string())
