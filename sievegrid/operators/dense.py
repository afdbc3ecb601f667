"""Exact cosine search: blocks of queries against blocks of vectors, merged per query.

A task multiplies one block of each and keeps the best k of every query, so only vectors and short lists move. All queries against all
rows is quadratic by nature; memory is bounded by the blocks, and vectors move once for each block of the other side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from sievegrid.operators.bm25 import top

BLOCK = 4096
#: Rows of a block at most where blocks are as large as memory allows, as a search's are.
LARGE = 1 << 14
#: Pairs that are worked out in double precision at a time.
PAIRS = 1 << 16
DIGITS = 6


def unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))


def _left(asked: np.ndarray, rounded: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None, k: int, off: np.ndarray | None = None, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs that may be among a query's best ``k``, by a product in single precision (``rounded``).

    Of the maxima of 4k groups of rows the k-th greatest is a bound that k rows reach; what comes within a margin of it is left. With ``off``
    the rows are stand-ins, each that far from the row itself at most; ``hidden`` says which rows a query doesn't look at.
    """
    rough = asked.astype(np.float32) @ rounded.T
    if hidden is not None:
        np.copyto(rough, np.float32(-np.inf), where=hidden)
    if same is not None:
        first, past = same
        for j in range(int((past - first).max(initial=0))):
            own = np.flatnonzero(past - first > j)
            rough[own, first[own] + j] = -np.inf
    wide = rough.shape[1] // (4 * k)
    margin = 2 * 10.0**-DIGITS + 4 * (asked.shape[1] + 2) * np.finfo(np.float32).eps
    bound = np.full(len(asked), -1.5, np.float32)
    if wide > 1:
        sure = rough[:, : 4 * k * wide] if off is None else rough[:, : 4 * k * wide] - off[: 4 * k * wide]
        most = sure.reshape(len(asked), 4 * k, wide).max(axis=2)
        bound = np.maximum(bound, np.partition(most, -k, axis=1)[:, -k] - margin)
    if off is not None:
        rough += off
    return np.nonzero(rough >= bound[:, None])


def _scored(asked: np.ndarray, units: np.ndarray, query: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score) of each query's best ``k`` among the given pairs, in double precision; of equal scores the earlier row comes first."""
    score = np.empty(len(query))
    for start in range(0, len(query), PAIRS):
        part = slice(start, start + PAIRS)
        score[part] = np.einsum("ij,ij->i", asked[query[part]], units[row[part]])
    score = np.round(score, DIGITS)
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], row[kept], score[kept]


def _best(asked: np.ndarray, units: np.ndarray, rounded: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score) of each query's best ``k``; of equal scores the earlier row comes first."""
    return _scored(asked, units, *_left(asked, rounded, same, k), k)


def knn(queries: DataFrame, rows: DataFrame, k: int = 50, query_id: str = "query_id", row_id: str = "child_id", vec_col: str = "embedding", skip_same: bool = False) -> DataFrame:
    """(query_id, child_id, score, ord): the k rows of highest cosine for each query; score is rounded, ties go to the smaller id."""
    left, right = usable(queries, query_id, vec_col), usable(rows, row_id, vec_col)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    counts = [x.count() for x in (left, right)]
    # each row moves once for each block of the other side: few large blocks of rows, and as many of queries as keep all cores at work
    many = [max(1, -(-counts[0] // LARGE), min(tasks, -(-counts[0] // BLOCK))), max(1, -(-counts[1] // LARGE))]
    single = all(isinstance(df.schema[vec_col].dataType.elementType, FloatType) for df in (queries, rows))
    vec = F.col("vec").cast("array<float>") if single else F.col("vec")

    def blocks(df: DataFrame, own: int) -> DataFrame:
        names = ("query_block", "row_block")
        df = df.withColumn(names[own], F.pmod(F.xxhash64("id"), F.lit(many[own])).cast("int"))
        df = df.withColumn(names[1 - own], F.explode(F.sequence(F.lit(0), F.lit(many[1 - own] - 1))))
        return df.select("query_block", "row_block", F.size("vec").alias("dim"), F.col("id").alias("id"), vec.alias("vec"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            dim = key[2].as_py()
            ids = right["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, q = ids[order], left["id"].to_numpy()
            units, asked = unit(right["vec"], dim)[order], unit(left["vec"], dim)
            rounded, found = units.astype(np.float32), []
            for start in range(0, len(q), 256):
                part = slice(start, start + 256)
                same = (np.searchsorted(ids, q[part]), np.searchsorted(ids, q[part], "right")) if skip_same else None
                query, row, score = _best(asked[part], units, rounded, same, k)
                found.append((q[part][query], ids[row], score))
            out = [np.concatenate(x) for x in zip(*found)]
        return pa.table(dict(zip(("query_id", "child_id", "score"), out)))

    keys = ["query_block", "row_block", "dim"]
    lists = blocks(left, 0).groupBy(*keys).cogroup(blocks(right, 1).groupBy(*keys)).applyInArrow(search, "query_id long, child_id long, score double")
    return top(lists, k)


def similar_pairs(rows: DataFrame, threshold: float, row_id: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, score) with a < b: all pairs of rows whose rounded cosine is above ``threshold``.

    Rows are cut into blocks and each pair of blocks is one task's product, so no task holds more than two blocks.
    """
    sound = usable(rows, row_id, vec_col)
    many = max(1, -(-sound.count() // BLOCK))
    dealt = sound.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(many - 1)))

    def side(low: bool) -> DataFrame:
        pairs = dealt.withColumn("other", other)
        pairs = pairs.where("own <= other" if low else "other <= own")
        return pairs.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.size("vec").alias("dim"), F.col("id").alias("id"), F.col("vec").alias("vec"))

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            dim, same = key[2].as_py(), key[0] == key[1]
            a, b = left["id"].to_numpy(), right["id"].to_numpy()
            units = [unit(x["vec"], dim) for x in (left, right)]
            for start in range(0, len(a), 256):
                score = np.round(units[0][start : start + 256] @ units[1].T, DIGITS)
                close = score > threshold
                if same:
                    close &= a[start : start + 256, None] < b
                i, j = np.nonzero(close)
                x, y = a[start + i], b[j]
                found.append((np.minimum(x, y), np.maximum(x, y), score[i, j]))
        return pa.table(dict(zip(("a", "b", "score"), (np.concatenate(x) for x in zip(*found)))))

    keys = ["low", "high", "dim"]
    return side(True).groupBy(*keys).cogroup(side(False).groupBy(*keys)).applyInArrow(join, "a long, b long, score double").where("a < b")
