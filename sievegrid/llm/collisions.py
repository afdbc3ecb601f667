"""Approximate nearest neighbours by counting collisions on sorted projections.

Every vector is projected on ``LINES`` random lines, each kept as one sorted array. A query opens a window round its own
place on every line, as wide as its radius. A vector in enough of the windows is a candidate and is verified by its
distance. The radius grows (virtual rehashing: the arrays stay, only the windows move) until ``k`` verified vectors lie
within it, or until the windows hold everything. A vector at the distance of the radius falls into a window with a known
chance, so the number of collisions asked for follows from the wanted recall; closer ones collide more often. A ``recall``
of 1 asks for none, which verifies every vector. No count of candidates ends a search.

Rows and queries are dealt into blocks. The task of one block of each holds the sorted arrays of its rows and counts
there, so that collisions are never moved; it returns the best k of each of its queries, which are merged in two levels.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, as queries or
rows, and neither do rows with a null id or, for a query, rows of another length; rows that share an id are separate
candidates (equal ones too) and one query (of the smallest vector), never their own answer; ties go to the smaller id; with
fewer than k candidates all are returned; an empty table gives an empty result; other columns are ignored, whatever their
names. There are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.llm.shared import Table, read_table

TOP = 10
QUERY_EVERY = 100
#: Chance that a vector at the distance of the radius is a candidate; closer ones have a higher one.
RECALL = 0.97
LINES = 64
#: Half of a window in radii, and by how much the radius grows.
HALF, GROWTH = 1.0, 1.25
#: The first radius is at least so small a part of the one that holds everything.
LEAST_PART = 1 / 1024
BLOCK_ROWS, BLOCK_QUERIES = 1 << 14, 1 << 12
_TILE = 64
SEED = 17


def collisions_needed(lines: int, recall: float, half: float = HALF) -> int:
    """The most collisions that a vector at the radius reaches with the chance of ``recall``."""
    if recall >= 1:
        return 0
    p = math.erf(half / math.sqrt(2))
    tail = 0.0
    for hits in range(lines, 0, -1):
        tail += math.comb(lines, hits) * p**hits * (1 - p) ** (lines - hits)
        if tail >= recall:
            return hits
    return 0


def _slices(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its stop, one run behind the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class Lines:
    """The sorted projections of a block of rows; all numbers must be of moderate size."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, lines: int = LINES, seed: int = SEED):
        self.rows, self.ids = rows, ids
        self.across = np.random.default_rng(seed).normal(size=(rows.shape[1], lines))
        on = (rows @ self.across).T
        order = np.argsort(on, axis=1, kind="stable")
        self.at = np.take_along_axis(on, order, axis=1)
        self.order = order.astype(np.int32).ravel()
        self.n = len(rows)

    def places(self, values: np.ndarray, side: str) -> np.ndarray:
        """Where each query's value (queries × lines) belongs in the array of its line."""
        return np.stack([np.searchsorted(line, values[:, i], side) for i, line in enumerate(self.at)], axis=1)

    def first_radius(self, on: np.ndarray, whole: np.ndarray, k: int) -> np.ndarray:
        """The distance on a line of about the k-th neighbour there, in the median of the lines."""
        around = np.clip(self.places(on, "left")[:, :, None] + np.arange(-k, k), 0, self.n - 1)
        far = np.abs(self.at[np.arange(len(self.at))[:, None], around] - on[:, :, None])
        return np.maximum(np.median(np.partition(far, k - 1, axis=2)[:, :, k - 1], axis=1) / HALF, whole * LEAST_PART)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, needed: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, distances, rows verified) for each query in turn: its k nearest among the verified, nearest first."""
        for start in range(0, len(queries), _TILE):
            yield from self._search_tile(queries[start : start + _TILE], query_ids[start : start + _TILE], k, needed)

    def _search_tile(self, queries: np.ndarray, query_ids: np.ndarray, k: int, needed: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        on = queries @ self.across
        whole = np.maximum(np.abs(on - self.at[:, 0]), np.abs(on - self.at[:, -1])).max(axis=1) / HALF * (1 + 1e-9)
        radius = np.minimum(self.first_radius(on, whole, k), whole)
        low = high = self.places(on, "left")
        base = np.arange(len(self.at)) * self.n
        counts = np.zeros((len(queries), self.n), dtype=np.int16)
        done = query_ids[:, None] == self.ids  # a query's own row is never a candidate
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(queries)
        verified = np.zeros(len(queries), dtype=np.int64)
        open_ = np.arange(len(queries))
        while len(open_):
            reach = radius[open_, None] * HALF
            new_low = np.minimum(self.places(on[open_] - reach, "left"), low[open_])
            new_high = np.maximum(self.places(on[open_] + reach, "right"), high[open_])
            going = []
            for at, q in enumerate(open_):
                fresh = _slices(np.concatenate([base + new_low[at], base + high[q]]), np.concatenate([base + low[q], base + new_high[at]]))
                counts[q] += np.bincount(self.order[fresh], minlength=self.n).astype(np.int16)
                last = radius[q] >= whole[q]
                hit = np.flatnonzero(~done[q] if last else (counts[q] >= needed) & ~done[q])
                if len(hit):
                    done[q, hit] = True
                    verified[q] += len(hit)
                    found[q] = self._best(np.concatenate([found[q][0], hit]), np.concatenate([found[q][1], _distance(self.rows[hit], queries[q])]), k)
                if not (last or (len(found[q][1]) >= k and found[q][1][k - 1] <= radius[q])):
                    going.append(q)
            low, high = low.copy(), high.copy()
            low[open_], high[open_] = new_low, new_high
            open_ = np.array(going, dtype=np.int64)
            radius[open_] = np.minimum(radius[open_] * GROWTH, whole[open_])
        for (rows, distances), n in zip(found, verified.tolist()):
            yield rows, distances, n

    def _best(self, rows: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], distances))[:k]
        return rows[order], distances[order]


def _distance(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    apart = rows - query
    return np.sqrt((apart * apart).sum(axis=1))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part; floats travel as floats, all sums are in double precision."""
    kind = "float" if "float" in df.select(vec_col).schema[0].dataType.simpleString() else "double"
    out = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast(kind)).alias("vec"))
    sound = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return out.where(sound)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest of the rows that were verified; score is the distance."""
    entries = Table(_usable(rows, id_col, vec_col).groupBy("id", "vec").agg(F.count("*").alias("copies")), "line-entries").df
    asked = Table(_usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec")), "line-queries").df
    row_blocks = max(1, -(-entries.count() // block_rows))
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    needed = collisions_needed(LINES, recall)

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int, *more: str) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64("id", "vec"), F.lit(n_own)).cast("int"))
        dealt = dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return dealt.select("query_block", "row_block", F.size("vec").alias("dim"), "id", "vec", *more)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            block_queries, block_rows = (_matrix(x["vec"], key[2].as_py()) for x in (left, right))
            power = int(np.frexp(max(np.abs(block_queries).max(), np.abs(block_rows).max()))[1])  # keeps squares in range, exactly
            ids, copies, names = right["id"].to_numpy(), right["copies"].to_numpy(), left["id"].to_numpy()
            lines = Lines(np.ldexp(block_rows, -power), ids)
            for name, (best, far, _) in zip(names, lines.search(np.ldexp(block_queries, -power), names, k, needed)):
                each = np.repeat(np.arange(len(best)), np.minimum(copies[best], k))[:k]
                for column, values in zip(out, (np.full(len(each), name), ids[best[each]], np.ldexp(far[each], power))):
                    column.append(values)
        columns = [np.concatenate(x) for x in out]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2], "block": np.full(len(columns[0]), key[1].as_py(), dtype=np.int32)})

    keys = ["query_block", "row_block", "dim"]
    left = blocks(asked, "query_block", query_blocks, "row_block", row_blocks)
    right = blocks(entries, "row_block", row_blocks, "query_block", query_blocks, "copies")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double, block int")
    branch = max(2, int(row_blocks**0.5))
    for level in ([F.floor(F.col("block") / branch)], []):
        best = W.partitionBy("query_id", *level).orderBy("score", "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_collisions(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)
