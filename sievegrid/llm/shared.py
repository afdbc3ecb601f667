"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sievegrid-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only in local mode without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[list[Table]] = []


class Table:
    """A frame written once as Parquet: it cuts lineage, and a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        for tables in _written:
            tables.append(self)

    def drop(self) -> None:
        delete(self.spark, self.path)


class BucketedTable(Table):
    """A table bucketed by a key: such tables of the same number of buckets are joined where they lie."""

    def __init__(self, df: DataFrame, name: str, key: str, buckets: int):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        self.name = self.path.rsplit("/", 1)[-1].replace("-", "_")
        df.write.bucketBy(buckets, key).option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)
        for tables in _written:
            tables.append(self)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables written inside at its end; what is needed later must be written outside of it or kept by ``keep``."""
    _written.append([])
    try:
        yield
    finally:
        for table in _written.pop():
            table.drop()


def keep(table: Table) -> Table:
    """Takes a table out of the reach of the innermost ``scratch`` block; outside of one it does nothing."""
    if _written:
        _written[-1].remove(table)
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of any store that Spark can write to."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
