"""Merging channels of ranked hits: reciprocal-rank fusion with score blending, de-duplication and pinning.

A channel row is (query_id, channel, child_id, score, ord), ``ord`` being the rank from 1. All steps are unions,
aggregations and windows per query, so many queries are merged in one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.operators.bm25 import top

WEIGHTS = {"bm25": 0.30, "dense": 0.50, "keyword": 0.20}
K, ALPHA, KEEP = 60, 0.3, 50
MOST_PINNED = 2
DIGITS = 6


def channel(hits: DataFrame, name: str) -> DataFrame:
    return hits.select("query_id", F.lit(name).alias("channel"), "child_id", F.col("score").cast("double").alias("score"), F.col("ord").cast("int").alias("ord"))


def normalised(score: Column, group: W) -> Column:
    """Min-max within a channel's answer; a flat answer is 1 throughout."""
    low, span = F.min(score).over(group), F.max(score).over(group) - F.min(score).over(group)
    return F.when(span < 1e-12, F.lit(1.0)).otherwise((score - low) / span)


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, k: int = K, alpha: float = ALPHA, keep: int = KEEP) -> DataFrame:
    """(query_id, child_id, score, ranks, scores, ord). Shares are of the weights of all channels asked, even of empty ones."""
    total = sum(weights.get(c, 0.0) for c in channels)
    used = [channel(df, c) for c, df in channels.items() if weights.get(c, 0.0) > 0]
    rows = reduce(DataFrame.unionByName, used)
    weight = reduce(lambda x, kv: F.when(F.col("channel") == kv[0], F.lit(kv[1])).otherwise(x), weights.items(), F.lit(0.0))
    group = W.partitionBy("query_id", "channel")
    part = weight / total * ((1 - alpha) / (k + F.col("ord")) + alpha * normalised(F.col("score"), group))
    rows = rows.withColumn("part", part)
    merged = rows.groupBy("query_id", "child_id").agg(
        F.round(F.sum("part"), DIGITS).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "ord")))).alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score")))).alias("scores"),
    )
    return top(merged, keep)


def first_per_parent(hits: DataFrame, parent: str = "parent_id", rank: str = "ord") -> DataFrame:
    """The best hit of each parent; a hit without one stands for itself. Ranks are closed up."""
    key = F.coalesce(F.nullif(F.col(parent).cast("string"), F.lit("")), F.concat(F.lit("\x1f"), F.col("child_id").cast("string")))
    hits = hits.withColumn("_first", F.row_number().over(W.partitionBy("query_id", key).orderBy(rank))).where("_first = 1")
    return hits.withColumn(rank, F.row_number().over(W.partitionBy("query_id").orderBy(rank))).drop("_first")


def best_of_variants(hits: DataFrame, variant: str = "variant") -> DataFrame:
    """One row per query and child over several wordings of a query: the highest score, the earliest wording on ties."""
    best = F.min_by(F.struct("score", variant), F.struct(-F.col("score"), F.col(variant)))
    out = hits.groupBy("query_id", "child_id").agg(best.alias("best"))
    return out.select("query_id", "child_id", F.col("best.score").alias("score"), F.col(f"best.{variant}").alias(variant))


def pin(final: DataFrame, pool: DataFrame, exact: DataFrame, want: int, most: int = MOST_PINNED) -> DataFrame:
    """Puts exact matches that ``final`` lacks in front, ``most`` at most, and cuts to ``want``.

    ``exact`` is (query_id, child_id, ord); a match counts only if the merged pool holds it.
    """
    missing = exact.join(final.select("query_id", "child_id"), ["query_id", "child_id"], "left_anti").withColumnRenamed("ord", "exact_ord")
    pinned = pool.drop("ord").join(missing.select("query_id", "child_id", "exact_ord"), ["query_id", "child_id"])
    pinned = pinned.withColumn("ord", F.row_number().over(W.partitionBy("query_id").orderBy("exact_ord", "child_id"))).where(F.col("ord") <= most).drop("exact_ord")
    both = pinned.withColumn("pinned", F.lit(True)).unionByName(final.withColumn("pinned", F.lit(False)), allowMissingColumns=True)
    order = W.partitionBy("query_id").orderBy(F.desc("pinned"), "ord")
    return both.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= want)


def participation(hits: DataFrame) -> DataFrame:
    """(query_id, channel, hits): how many of a query's hits each channel had a part in."""
    return hits.select("query_id", F.explode(F.map_keys("ranks")).alias("channel")).groupBy("query_id", "channel").agg(F.count("*").alias("hits"))
