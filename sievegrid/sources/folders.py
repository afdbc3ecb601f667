"""The shared folder for checkpoints, and the spread of small tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Leaves a session's own ``spark.checkpoint.dir`` as it is; only a local session without one gets a folder."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sievegrid-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in ``spark.checkpoint.dir``; only a local session without that setting uses a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or _own_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of any store that Spark can write to; what isn't there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of a table per task from which its own splits are enough.
ENOUGH = 8 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals a table that is too small for as many splits as there are cores over all of them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < ENOUGH * cores else df
