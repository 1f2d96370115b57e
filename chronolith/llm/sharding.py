"""Sharding: contiguous shards of near equal bytes, cut from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import no_clash, ordered, written

#: A group of equal texts stays in one shard if it holds at most this part of a shard.
WHOLE_GROUP = 0.02


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals all rows into `shards` shards of near equal size and gives each row its slot in its shard.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1.  Rows are put in
    the order of a hash of their text and then `key`, so equal texts are neighbours;
    the order is dealt out by range, prefix sums come from per-partition totals, and
    shard i ends where the sum passes (i + 1) / shards of the total.  A cut that falls
    into a group of equal texts moves to the nearer end of the group, unless the group
    holds more than WHOLE_GROUP of a shard; such a group is split where the cut falls.

    Returns key, size, text_crc32, shard, slot (gapless from 0 in every shard) and the
    columns `keep`, under their own names behind those.  Null keys sort first; equal
    rows are rows of their own; an empty table gives no rows; columns of other names
    are left alone, and one in `keep` named like a result is dropped; a key named like
    a result is a ValueError.
    """
    no_clash([key], ["size", "text_crc32", "shard", "slot"])
    own = ["size", "text_crc32", "shard", "slot", key]
    slim = docs.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("crc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("g"),
        F.struct(*(F.col(c) for c in keep if c not in own)).alias("rest") if any(c not in own for c in keep) else F.lit(None).alias("rest"),
    )
    if not any(c not in own for c in keep):
        slim = written(slim.drop("rest"), "sizes")  # narrow, and read twice
    rows = ordered(slim, [F.col("g"), F.col("crc"), F.col("k")], "size")
    total = rows.agg(F.max(F.col("before") + F.col("size"))).first()[0]
    if total is None:
        total = 0
    aims = [total * i // shards for i in range(1, shards)]
    cuts = _snapped(rows, aims, total / shards * WHOLE_GROUP) if total else []
    at: Column = F.lit(0)
    for c in cuts:
        at = at + (F.col("before") >= F.lit(c)).cast("int")
    placed = rows.withColumn("shard", at)
    first = placed.groupBy("shard").agg(F.min("ord").alias("first"))  # a row a shard
    out = placed.join(F.broadcast(first), "shard")
    rest = ["rest.*"] if "rest" in out.columns else []
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int"), (F.col("ord") - F.col("first")).alias("slot"), *rest)


def _snapped(rows: DataFrame, aims: list[int], most: float) -> list[int]:
    """The aims, each moved to the nearer end of the group of equal texts that it falls into; a row a cut is read."""
    inside = F.lit(False)
    for a in aims:
        inside = inside | ((F.col("before") < F.lit(a)) & (F.col("before") + F.col("size") > F.lit(a)) | (F.col("before") == F.lit(a)))
    hit = rows.where(inside).select("g", "crc").distinct()  # at most one group a cut
    groups = rows.join(F.broadcast(hit), ["g", "crc"]).groupBy("g", "crc").agg(F.min("before").alias("lo"), F.max(F.col("before") + F.col("size")).alias("hi"))
    spans = [(r["lo"], r["hi"]) for r in groups.collect()]
    out = []
    for a in aims:
        for lo, hi in spans:
            if lo < a < hi and hi - lo <= most:
                a = lo if a - lo <= hi - a else hi
        out.append(a)
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text", key: str = "doc_id") -> None:
    """Writes all columns of docs as Parquet, a folder a shard, with shard and slot."""
    keep = tuple(c for c in docs.columns if c != key)
    out = shard(docs, shards, text, key, keep)
    out.repartition("shard", F.pmod(F.hash("slot"), F.lit(16))).write.partitionBy("shard").parquet(path)


__all__ = ["WHOLE_GROUP", "shard", "write_shards"]
