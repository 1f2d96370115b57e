"""The files of a working tree: listing, classes, contents."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import classify
from .gitlog import git


def tracked(cwd: str, pathspec: str | None = None) -> list[str]:
    return [p for p in git(cwd, "ls-files", "-z", *(["--", pathspec] if pathspec else [])).split("\0") if p]


def untracked(cwd: str) -> list[str]:
    return [p for p in git(cwd, "ls-files", "-z", "--others", "--exclude-standard").split("\0") if p]


def files(spark: SparkSession, root: str, include_untracked: bool = False, exclude: Sequence[str] = (), pathspec: str | None = None) -> DataFrame:
    """(rel, size, mtime_ns) with classes and skip reasons; sizes are read by the executors, for which the tree is at the same path."""
    names = tracked(root, pathspec) + (untracked(root) if include_untracked else [])
    listed = spark.createDataFrame([(n,) for n in sorted(set(names))], "rel string")

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, time = [], []
            for rel in b.column(0).to_pylist():
                try:
                    s = os.lstat(os.path.join(root, rel))
                    size.append(s.st_size if os.path.isfile(os.path.join(root, rel)) and not os.path.islink(os.path.join(root, rel)) else -1)
                    time.append(s.st_mtime_ns)
                except OSError:
                    size.append(None)
                    time.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(time, pa.int64())], names=["rel", "size", "mtime_ns"])

    return classify(listed.mapInArrow(stat, "rel string, size long, mtime_ns long"), exclude)


def contents(records: DataFrame, root: str) -> DataFrame:
    """records (rel, language) with content (null where it can't be read)."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*records.schema.fields, StructField("content", BinaryType())])
    at = records.columns.index("rel")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):  # few files at once
                part = b.slice(i, 64)
                out = []
                for rel in part.column(at).to_pylist():
                    try:
                        with open(os.path.join(root, rel), "rb") as f:
                            out.append(f.read())
                    except OSError:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "content"])

    return records.mapInArrow(read, schema)


def kept(records: DataFrame, language: str | None = None) -> DataFrame:
    """The files to be scanned; the language filter comes before the scan."""
    out = records.where(F.col("skip").isNull())
    return out.where(F.lower("language") == language.lower()) if language else out
