"""First-wins and greedy de-duplication, and incremental maintenance of keyed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.sources.folders import use_checkpoints


def first_by(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order; every tie needs a column in ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_id_by(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Rows whose id is the smallest of their key; the minimum is pre-aggregated, so a hot key moves as one row per task."""
    keyed = rows.withColumn("_key", F.sha2(key.cast("binary"), 256))
    least = keyed.groupBy("_key").agg(F.min(id_col).alias(id_col))
    return keyed.join(least, ["_key", id_col], "left_semi").drop("_key")


def last_good(manifest: DataFrame, keys: list[str], order: list[Column], good: Column) -> DataFrame:
    """The latest good row of each key; a later failure never hides an earlier success."""
    return first_by(manifest.where(good), keys, order)


def to_add(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(existing.select(*keys), keys, "left_anti")


def to_remove(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(new.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of the same key."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


#: Pairs that one task settles (16 bytes each), and rounds in which all tasks settle what they can before that.
TASK_PAIRS, ROUNDS = 1 << 20, 4


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint()  # lineage would double with each round


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the later rows of (a, b, kept) in id order; ``kept`` is null where ``a`` is still open."""
    held = [[column.to_numpy(zero_copy_only=False) for column in (b.column(0), b.column(1), b.column(2).cast(pa.int8()).fill_null(-1))] for b in batches]
    if not held:
        return
    first, later, known = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(later, kind="stable")
    kept: dict[int, bool] = {}
    for a, b, sure in zip(first[order].tolist(), later[order].tolist(), known[order].tolist()):
        stays = bool(sure) if sure >= 0 else kept.get(a, True)  # a row that is later than none has no earlier neighbour left
        kept[b] = kept.get(b, True) and not stays
    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.bool_())], names=["id", "now"])


def greedy_kept(pairs: DataFrame, rows: DataFrame, id_col: str = "id", task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Ids kept when rows come in id order and one near an earlier kept row goes; ``pairs`` is (a, b), a < b.

    A round settles the rows whose earlier neighbours are all settled: a row near a kept one goes, a row whose earlier
    neighbours all went is kept. After ``ROUNDS`` of them, or when few pairs are open, the rows of the smallest ids with at most
    about ``task_pairs`` open pairs are settled by one task, so that the number of rounds follows the number of pairs and not the
    length of a chain. Only counts and one id reach the driver. Rounds are checkpointed in ``spark.checkpoint.dir``.

    Repeated pairs count once; ids without a pair are kept; no rows give an empty result.
    """
    use_checkpoints(rows.sparkSession)
    edges = _cut(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    state, turn = rows.select(F.col(id_col).alias("id"), F.lit(None).cast("boolean").alias("kept")), 0
    while True:
        near = edges.join(state.select(F.col("id").alias("a"), "kept"), "a").groupBy(F.col("b").alias("id"))
        near = near.agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("hit"), F.count_if(F.col("kept").isNull()).alias("open"))
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = _cut(state.join(near, "id", "left").select("id", settled.alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            return state.where("kept").select(F.col("id").alias(id_col))
        alive = state.where("kept IS NULL OR kept").select(F.col("id").alias("a"), "kept")
        edges = _cut(edges.join(state.where("kept IS NULL").select(F.col("id").alias("b")), "b", "left_semi").join(alive, "a").select("a", "b", "kept"))
        count, turn = edges.count(), turn + 1
        if count <= task_pairs or turn >= ROUNDS:
            part = task_pairs / count
            block = edges if part >= 1 else edges.where(F.col("b") <= edges.approxQuantile("b", [part], part / 4)[0])
            solved = block.repartition(1).mapInArrow(_settle, "id long, now boolean")
            state = _cut(state.join(solved, "id", "left").select("id", F.coalesce("kept", "now").alias("kept")))
            turn = 0
        edges = edges.select("a", "b")
