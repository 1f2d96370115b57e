"""The measurement cache: shapes by a key of path, size, time and scanner, as a partitioned Parquet table."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3


def fingerprint() -> str:
    """Of the scanner's sources: a changed scanner makes all keys new."""
    here = Path(__file__).parent.parent
    return hashlib.sha1(b"".join((here / p).read_bytes() for p in ("functions/lexer.py", "registry.py"))).hexdigest()[:12]


def key(mark: str, rel: Column, size: Column, mtime_ns: Column) -> Column:
    """22 characters of URL-safe base64 of the SHA-1 of version, scanner, path, size and time."""
    digest = F.unhex(F.sha1(F.concat_ws("\0", F.lit(str(VERSION)), F.lit(mark), rel, size.cast("string"), mtime_ns.cast("string"))))
    return F.substring(F.translate(F.base64(digest), "+/", "-_"), 1, 22)


def shard(rel: Column) -> Column:
    """The first two segments of the path's directory."""
    parts = F.split(rel, "/")
    return F.when(F.size(parts) == 1, F.lit("_root")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/"))


def split(records: DataFrame, cached: DataFrame) -> DataFrame:
    """records with hit: whether cached has their cache_key."""
    return records.join(cached.select("cache_key", F.lit(True).alias("hit")).distinct(), "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_rate(records: DataFrame) -> DataFrame:
    s = records.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return s.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))


def store(shapes: DataFrame, path: str, day: str) -> None:
    """Appends shapes (with cache_key and rel) under their shard and day."""
    shapes.withColumn("shard", shard(F.col("rel"))).withColumn("day", F.lit(day)).write.mode("append").partitionBy("shard", "day").parquet(path)


def load(spark: SparkSession, path: str, since: str | None = None) -> DataFrame | None:
    """The cached shapes, of days from `since` on (older partitions are pruned unread); None where there is no cache."""
    try:
        out = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return out.where(F.col("day") >= since) if since else out
