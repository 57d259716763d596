"""Written intermediate tables: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_run: ContextVar[str | None] = ContextVar("run", default=None)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="latelane-")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh temporary one in local mode only."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses."""
    run = _run.get()
    place = f"{run}/{uuid.uuid4().hex}" if run else uuid.uuid4().hex
    return f"{scratch_root(spark)}/latelane/{place}/{name}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Everything written inside lies in one folder, which is deleted at the end, after a
    failure too. What outlives the run must have been written elsewhere by then."""
    run = uuid.uuid4().hex
    token = _run.set(run)
    folder = f"{scratch_root(spark)}/latelane/{run}"
    try:
        yield folder
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a scan of it.

    Later readers prune columns and push filters into the scan, and a lost executor
    costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
