"""A keyed table in hashed buckets: an upsert rewrites the buckets that its keys fall into, a lookup reads those of its keys.

A bucket is a partition of the stored table, so what is touched is a question of folders: changed rows are merged with their
buckets' rows, written beside the store first, and then put in place of these buckets alone by dynamic partition overwrite. A bucket
that has lost its last row goes as a folder. The driver sees bucket numbers, never keys.

Defined results: rows without a key are not stored; of rows that share a key in one change the greatest counts, column by
column; deleting what isn't there changes nothing; a lookup of no keys, or in an empty store, is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.sources.folders import delete, new_path

BUCKETS = 256


@dataclass
class Store:
    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: str

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> Store:
        """A new store of all rows; what the path held before goes."""
        spark = rows.sparkSession
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        delete(spark, path)
        spark.createDataFrame([(key, buckets, kind)], "key string, buckets int, kind string").write.parquet(f"{path}/about")
        store = Store(spark, path, key, buckets, kind)
        store._write(store._latest(rows))
        return store

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        about = spark.read.parquet(f"{path}/about").first()
        return Store(spark, path, about.key, about.buckets, about.kind)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        rows = rows.where(F.col(self.key).isNotNull())
        rows = rows.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("rest")).select(self.key, "rest.*") if rest else rows.distinct()
        return rows.select(*[f.name for f in self._empty().schema if f.name != "_bucket"]).withColumn("_bucket", self._bucket(F.col(self.key)))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.schema}, _bucket int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/rows")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self._stored().drop("_bucket")

    def count(self) -> int:
        return self._stored().count()

    def _touched(self, keyed: DataFrame) -> list[int]:
        return sorted(r[0] for r in keyed.select("_bucket").distinct().collect())  # ``buckets`` at most

    def upsert(self, rows: DataFrame) -> None:
        """Puts rows in, in place of those of the same keys."""
        aside = new_path(self.spark, "store-change")
        self._latest(rows).write.parquet(aside)
        new = self.spark.read.parquet(aside)
        self._replace(new, new)
        delete(self.spark, aside)

    def remove(self, keys: DataFrame) -> None:
        """Takes out the rows of the keys in the column of the store's key."""
        gone = keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct().withColumn("_bucket", self._bucket(F.col(self.key)))
        self._replace(gone, None)

    def _replace(self, keyed: DataFrame, new: DataFrame | None) -> None:
        touched = self._touched(keyed)
        if not touched:
            return
        merged = self._stored().where(F.col("_bucket").isin(touched)).join(keyed.select(self.key, "_bucket"), [self.key, "_bucket"], "left_anti")
        merged = merged if new is None else merged.unionByName(new)
        aside = new_path(self.spark, "store-buckets")
        merged.write.parquet(aside)
        kept = self.spark.read.parquet(aside)
        self._write(kept)
        for bucket in set(touched) - set(self._touched(kept)):
            delete(self.spark, f"{self.path}/rows/_bucket={bucket}")
        delete(self.spark, aside)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in the column of the store's key; only the buckets of these keys are read."""
        wanted = keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct().withColumn("_bucket", self._bucket(F.col(self.key)))
        held = self._stored().where(F.col("_bucket").isin(self._touched(wanted)))
        return held.join(wanted, [self.key, "_bucket"], "left_semi").drop("_bucket")

    def reset(self) -> None:
        """Takes out all rows."""
        delete(self.spark, f"{self.path}/rows")
        self._write(self._empty())
