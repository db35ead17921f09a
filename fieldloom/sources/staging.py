"""Tables between the steps of long jobs, written where all executors see them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see. Where the session names none, a temporary one of this machine will do as long
    as all runs here (tests); on a cluster that is an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        context.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below shared_dir that goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet below shared_dir and returns the written table, which goes when the session ends: what follows
    neither computes df again nor loses it with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, work: Sequence[Callable[[], T]], most: int = 8) -> list[T]:
    """What each function returns, in their order. They run in threads, `most` at a time, so that jobs of few tasks share the cluster."""
    with ThreadPoolExecutor(max(1, min(most, len(work)))) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]
