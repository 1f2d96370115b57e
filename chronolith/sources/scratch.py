"""The folder for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    Where it is unset, a folder of its own on a local master, as in tests; a cluster has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="chronolith-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, name: str, sources: Iterable[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a written table, which is made once a session for the same files of its sources.

    For relations that many queries begin with: the shuffle that makes them is paid once.  Files are
    taken not to change under their names while the session lasts.
    """
    key = (spark.sparkContext.applicationId, name, *(f for s in sources for f in sorted(s.inputFiles())))
    if key not in _made:
        _made[key] = written(make(), name)
    return _made[key]
