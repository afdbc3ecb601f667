"""Exact top-k search by tiled matrix products.

Queries and rows are hashed into blocks of bounded size. Each pair of a query block and a row block is one group:
its task multiplies query tiles with row tiles, selects the best k of every query in each tile and merges them as
it goes. The lists of a query are then merged in two levels, first within runs of neighbouring blocks, then over
these. Only vectors of a block and k rows per query and block move; no tile of scores leaves its task.

Components are turned to whole numbers, so scores are exact whatever the tiling; ties go to the smaller id.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, as queries or rows,
and neither do rows with a null id or, for a query, rows of another length; rows that share an id are
separate candidates and one query (of the smallest vector), never their own answer; with fewer than k candidates all are returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.llm.shared import read_table

TOP = 5
SCALE = 256
QUERY_EVERY = 50
#: Rows of a block; a task holds one block of queries and one of rows.
BLOCK_ROWS = 8192
TILE_QUERIES, TILE_ROWS = 256, 2048
_EXACT = 2.0**53
#: Stands for no score; its negative is a number too.
NONE = np.iinfo(np.int64).min + 1


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where all sums stay exact there."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def select(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by falling score, then rising id, sorted; ``ids`` has one row or one for each."""
    ids = np.broadcast_to(ids, score.shape)
    if score.shape[1] > 4 * k:  # partial selection: keep what beats or ties the k-th score, as few columns as hold all of it
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k, None]
        sure = score >= least
        width = int(sure.sum(axis=1).max())
        if width < score.shape[1]:
            at = np.argsort(~sure, axis=1, kind="stable")[:, :width]
            score, ids, sure = (np.take_along_axis(x, at, axis=1) for x in (score, ids, sure))
            score = np.where(sure, score, NONE)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)


def search_block(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query_id, vec_id, score) of the best k of each query among the rows, without its own id."""
    for q in range(0, len(query_ids), TILE_QUERIES):
        own = query_ids[q : q + TILE_QUERIES]
        best = np.full((len(own), 0), NONE), np.zeros((len(own), 0), dtype=np.int64)
        for r in range(0, len(row_ids), TILE_ROWS):
            ids = row_ids[r : r + TILE_ROWS]
            score = scores(queries[q : q + TILE_QUERIES], rows[r : r + TILE_ROWS])
            score[own[:, None] == ids] = NONE
            found = select(score, ids, k)
            best = select(np.hstack([best[0], found[0]]), np.hstack([best[1], found[1]]), k)
        real = best[0] > NONE
        yield np.repeat(own, real.sum(axis=1)), best[1][real], best[0][real]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec, dim) of usable rows, components as floor(scale * x)."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    out = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    out = out.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return out.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("vec"), F.size("v").alias("dim"))


def top_k(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k other rows for each query."""
    rows, queries = whole_vectors(rows, id_col, vec_col, scale), whole_vectors(queries, id_col, vec_col, scale)
    queries = queries.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    row_blocks = max(1, -(-rows.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // block_rows))

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).select("query_block", "row_block", "dim", "id", "vec")

    left = blocks(queries, "query_block", query_blocks, "row_block", row_blocks)
    right = blocks(rows, "row_block", row_blocks, "query_block", query_blocks)
    keys = ["query_block", "row_block", "dim"]

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, dim = key[1].as_py(), key[2].as_py()
        if left.num_rows and right.num_rows:
            found = list(search_block(left["id"].to_numpy(), _matrix(left["vec"], dim), right["id"].to_numpy(), _matrix(right["vec"], dim), k))
            columns = [np.concatenate(x) for x in zip(*found)]
        else:
            columns = [np.zeros(0, dtype=np.int64)] * 3
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2], "block": np.full(len(columns[0]), block, dtype=np.int32)})

    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long, block int")
    branch = max(2, int(row_blocks**0.5))
    for level in ([F.floor(F.col("block") / branch)], []):
        best = W.partitionBy("query_id", *level).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v r ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e))
SELECT query_id, rank::integer AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {TOP}
"""
