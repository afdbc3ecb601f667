"""Connected components of a link table: parts are solved in tasks, what is left by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.shared import Table

#: Links that one task solves; a table of at most so many is solved whole by one task (16 MB of links).
TASK_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for each node that is not that smallest one itself."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(names)), np.split(at, 2)
    while len(x):
        high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        apart = high != low
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (further := root[root] != root).any():
            root = np.where(further, root[root], root)
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[column.to_numpy() for column in batch.columns] for batch in batches]
    if held:
        a, b = forest(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _contract(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (a, b) with a > b."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    hooked = large.join(lowest, "a")
    small = hooked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
    return small.distinct()


def connected_components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for each node of the long-valued (a, b) links; root is the component's smallest node.

    A table of at most ``task_links`` links is solved by one task. A larger one is cut into parts of that size, each
    replaced by its own forest, and then contracted in rounds of joins and aggregations, written to the shared
    folder; the driver sees a count and a checksum only. Every round at least halves the depth of what is left.
    Links of a node to itself are dropped; no links give an empty result.
    """
    now = Table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    mark, count = None, now.df.count()
    while count:
        solved = Table(now.df.repartition(-(-count // task_links)).mapInArrow(_solve, "a long, b long"), "links")
        now.drop()
        now = solved
        if count <= task_links:
            break
        after = Table(_contract(now.df), "links")
        now.drop()
        now = after
        seen = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark, count = seen, seen[0]
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.df.select("b", "b").distinct())
