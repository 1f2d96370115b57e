"""Which files tests reach, and how directories are covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import test_stem, top_dirs


def tested(edges: DataFrame, files: DataFrame, keep_extension: bool = False) -> DataFrame:
    """(rel) of files that a test imports or is named after; files has rel and test."""
    tests = files.where("test").select("rel")
    by_import = edges.join(tests.withColumnRenamed("rel", "src"), "src", "left_semi").select(F.col("dst").alias("rel"))
    by_name = tests.select(test_stem(F.col("rel"), keep_extension).alias("rel")).join(files.select("rel"), "rel", "left_semi")
    return by_import.union(by_name).distinct()


def totals(files: DataFrame) -> DataFrame:
    """(source_files, covered, ratio); files has test and is_tested."""
    s = files.where("not test").agg(F.count("*").alias("source_files"), F.count_if("is_tested").alias("covered"))
    return s.withColumn("ratio", F.when(F.col("source_files") == 0, 0.0).otherwise(F.col("covered") / F.col("source_files")))


def by_directory(files: DataFrame, depth: int = 2, directory: str | None = None) -> DataFrame:
    """Per directory with sources: source, tests, covered, code, ratio, code_per_test (null without tests)."""
    where = F.col(directory) if directory else top_dirs(F.col("rel"), depth)
    s = files.groupBy(where.alias("dir")).agg(
        F.count_if(~F.col("test")).alias("source"), F.count_if("test").alias("tests"), F.count_if(~F.col("test") & F.col("is_tested")).alias("covered"),
        F.coalesce(F.sum(F.when(~F.col("test"), F.col("code"))), F.lit(0)).cast("long").alias("code"), F.min("rel").alias("first_rel"),
    )
    s = s.where("source > 0")
    return s.withColumn("ratio", F.col("covered") / F.col("source")).withColumn("code_per_test", F.when(F.col("tests") > 0, F.col("code") / F.col("tests")))


def least_covered(dirs: DataFrame, limit: int = 20) -> DataFrame:
    """Directories without tests, at most min(10, limit); if there are none the first min(6, limit)."""
    order = [F.col("ratio"), F.desc("code"), F.col("first_rel")]
    bare = dirs.where("tests = 0").orderBy(*order).limit(min(10, limit))
    some = bare.agg((F.count("*") > 0).alias("some"))
    rest = dirs.orderBy(*order).limit(min(6, limit)).crossJoin(F.broadcast(some)).where("not some").drop("some")
    return bare.unionByName(rest)
