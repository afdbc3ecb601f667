"""Approximate cosine search: an inverted file of coarse cells with product-quantised residuals, stored by cell.

The index is a table of (cell, id, codes, error, vec), partitioned by cell, and a small model: the cells' centroids and a codebook for
each stretch of the residuals. A query goes to all cells that are further away than its nearest one by no more than a margin;
the margin was measured while building, as the one within which so many of the exact neighbours of ``CALIBRATION`` sampled rows lie.

A code says where a vector is up to its error, so each has a least and a most distance; what can't be among the best k of its tile
falls away, and nothing else does. The rest is verified on the vectors themselves. ``candidates`` reads the codes alone. A search multiplies
blocks of queries with what the codes stand for, and where that leaves more than ``PAYS`` of the pairs, with the vectors in single precision. Within the cells visited a search is therefore exact, and with a ``recall`` of 1, which visits all cells, so is
its result. Small cells lie together on a shelf and large ones are cut into tiles: a task screens and verifies one tile of rows for one of
queries, so a query moves once for each shelf that it visits, a row once for each tile of queries, and only short lists come back.

Defined results: an index holds vectors of one length, that of most sampled rows; vectors of another length, null, zero, with null or non-finite
components or without an id are in no index and find nothing; ties go to the smaller id; ids are taken to be unique, repeated rows are found
repeatedly; an empty table gives an empty index, which finds nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import dense
from sievegrid.operators.bm25 import top

RECALL, NEIGHBOURS = 0.98, 10
#: Cells at most, and rows of a cell, about, while there may be more cells.
MOST_CELLS, CELL_ROWS = 4096, 64
#: Rows that the model is fitted on for each cell, and at least; rows whose neighbours set the margin.
PER_CELL, LEAST_SAMPLE, CALIBRATION = 16, 4096, 256
#: Components in a stretch of a residual; codes of a codebook.
STRETCH, CODES = 4, 256
TILE_ROWS, TILE_QUERIES = 1 << 16, 1 << 10
#: Rows of a shelf or of a tile of a larger cell, about, and queries that meet them in one task; products a task holds at once.
SHELF_ROWS, SHELF_QUERIES, MOST_HELD = 1 << 14, 1 << 14, 1 << 21
#: The share of a block's pairs that codes may leave to be verified one by one; beyond it the rest of the tile is searched without them.
PAYS = 1 / 64
SEED = 11
_AT_ONCE = 4096
_ENTRIES = "cell int, id long, codes binary, error double, vec array<double>"
#: Scores are rounded, so a distance is held to be lower by what could round up to the same score.
_SLACK = 10.0**-dense.DIGITS


def _square(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1), 0)


def _fitted(rows: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = _square(rows, centres).argmin(axis=1)
        held = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, weights=rows[:, axis], minlength=len(centres)) for axis in range(rows.shape[1])], axis=1)
        centres[held > 0] = total[held > 0] / held[held > 0, None]
    return centres


@dataclass
class Model:
    """Centroids of the cells, codebooks of the residuals' stretches, and how much further than the nearest a cell may be."""

    cells: np.ndarray
    books: list[np.ndarray]
    margin: float

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    def stretches(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, start : start + STRETCH] for start in range(0, self.dim, STRETCH)]

    def coded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, error) of rows: the error is the distance between a row and what its code stands for."""
        cell = _square(unit, self.cells).argmin(axis=1)
        rest = unit - self.cells[cell]
        codes = np.stack([_square(part, book).argmin(axis=1) for part, book in zip(self.stretches(rest), self.books)], axis=1).astype(np.uint8)
        lost = unit - self.decoded(cell, codes)
        return cell, codes, np.sqrt((lost * lost).sum(axis=1))

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for."""
        return self.cells[cell] + np.hstack([book[codes[:, i]] for i, book in enumerate(self.books)])

    def excess(self, unit: np.ndarray) -> np.ndarray:
        """How much further than its nearest cell each cell is from each row."""
        far = np.sqrt(_square(unit, self.cells))
        return far - far.min(axis=1)[:, None]

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Of a query to what the codes of a cell stand for."""
        parts = self.stretches((query - self.cells[cell])[None])
        return np.sqrt(sum(_square(part, book)[0][codes[:, i]] for i, (part, book) in enumerate(zip(parts, self.books))))


@dataclass
class Index:
    path: str
    entries: DataFrame
    model: Model | None

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """The model is read whole: at most ``MOST_CELLS`` centroids and ``CODES`` codes for each stretch."""
        parts: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/model").orderBy("part", "number").collect():
            parts.setdefault(r.part, []).append(r.values)
        entries = spark.read.schema(_ENTRIES).parquet(f"{path}/entries")
        if not parts:
            return Index(path, entries, None)
        books = [np.array(parts[i]) for i in sorted(parts) if i > 0]
        return Index(path, entries, Model(np.array(parts[0]), books, float(parts[-1][0][0])))


def _units(rows: pa.Array, dim: int) -> np.ndarray:
    return dense.unit(pa.chunked_array([rows]), dim)


def _sampled(rows: DataFrame, total: int, most: int, salt: int) -> DataFrame:
    """About ``most`` rows by a hash of their ids, at most one and a half times as many."""
    share = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, 1.2 * most / max(total, 1)) * (1 << 30))
    return rows.where(share).limit(int(1.5 * most))


def _calibrated(rows: DataFrame, model: Model, total: int, recall: float) -> float:
    """The margin within which the cells of so many exact neighbours lie; at most ``CALIBRATION`` lists reach the driver."""
    asked = _sampled(rows, total, CALIBRATION, 2)
    near = dense.knn(asked, rows, NEIGHBOURS, "id", "id", "vec", skip_same=True)
    pairs = near.join(rows.select(F.col("id").alias("child_id"), F.col("vec").alias("there")), "child_id").join(asked.select(F.col("id").alias("query_id"), "vec"), "query_id").select("vec", "there").toArrow()
    if not pairs.num_rows:
        return float("inf")
    here, there = (dense.unit(pairs[c], model.dim) for c in ("vec", "there"))
    cell = _square(there, model.cells).argmin(axis=1)
    return float(np.quantile(model.excess(here)[np.arange(len(cell)), cell], recall, method="higher")) + 1e-9


def build(rows: DataFrame, path: str, id_col: str = "child_id", vec_col: str = "embedding", recall: float = RECALL, cells: int | None = None) -> Index:
    """Writes an index to ``path`` and loads it; ``cells`` by default follow the number of rows."""
    spark = rows.sparkSession
    usable = dense.usable(rows, id_col, vec_col)
    total = usable.count()
    cells = cells or int(min(MOST_CELLS, max(1, round((total / CELL_ROWS) ** 0.5 * 4))))
    sample = _sampled(usable, total, max(LEAST_SAMPLE, PER_CELL * cells), 1).select("vec").toArrow()["vec"].combine_chunks()  # bounded by ``MOST_CELLS``
    lengths = Counter(np.diff(np.asarray(sample.offsets)).tolist()) if len(sample) else Counter()
    parts: list[tuple[int, int, list[float]]] = []
    if not lengths:
        spark.createDataFrame([], _ENTRIES).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/entries")
    else:
        dim = max(lengths, key=lambda n: (lengths[n], n))
        alike = sample.filter(pa.array(np.diff(np.asarray(sample.offsets)) == dim))
        unit, rng = _units(alike, dim), np.random.default_rng(SEED)
        model = Model(_fitted(unit, cells, rng), [], float("inf"))
        rest = unit - model.cells[_square(unit, model.cells).argmin(axis=1)]
        model.books = [_fitted(part, CODES, rng) for part in model.stretches(rest)]
        usable = usable.where(F.size("vec") == dim)
        if recall < 1:
            model.margin = _calibrated(usable, model, total, recall)
        shared = spark.sparkContext.broadcast(model)  # bounded as ``Index.load`` says

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE)):
                cell, codes, error = shared.value.coded(_units(part.column(1), shared.value.dim))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), part.column(1)], names=["cell", "id", "codes", "error", "vec"])

        # cells of many rows are written by many tasks, and small ones together
        usable.select("id", "vec").mapInArrow(placed, _ENTRIES).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/entries")
        parts = [(-1, 0, [model.margin]), *((0, i, x) for i, x in enumerate(model.cells.tolist())), *((m + 1, i, x) for m, book in enumerate(model.books) for i, x in enumerate(book.tolist()))]
    spark.createDataFrame(parts, "part int, number int, values array<double>").write.mode("overwrite").parquet(f"{path}/model")
    return Index.load(spark, path)


def _probed(queries: DataFrame, model: Model) -> DataFrame:
    """(query_id, vec, cell): each query with each cell within the margin."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE)):
            query, cell = np.nonzero(shared.value.excess(_units(part.column(1), shared.value.dim)) <= shared.value.margin)
            at = pa.array(query)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cell, pa.int32())], names=["query_id", "vec", "cell"])

    return queries.where(F.size("vec") == model.dim).select("id", "vec").mapInArrow(each, "query_id long, vec array<double>, cell int")


def _visited(queries: DataFrame, model: Model) -> list[int]:
    """All cells within the margin of any query, ``MOST_CELLS`` at most; a task returns each once."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value.cells), dtype=bool)
        for part in (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE)):
            seen |= (shared.value.excess(_units(part.column(0), shared.value.dim)) <= shared.value.margin).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["cell"])

    return [r.cell for r in queries.where(F.size("vec") == model.dim).select("vec").mapInArrow(each, "cell int").distinct().collect()]


def candidates(index: Index, queries: DataFrame, k: int = 50, skip_same: bool = False) -> DataFrame:
    """(query_id, cell, id): all rows of the cells visited that may be among the best k, by their codes; ``queries`` is (id, vec)."""
    spark, model = queries.sparkSession, index.model
    probed = _probed(queries, model)
    visited = _visited(queries, model)
    held = index.entries.where(F.col("cell").isin(visited)) if visited else index.entries.where("false")
    row_tiles = held.groupBy("cell").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("row_tiles"))
    query_tiles = probed.groupBy("cell").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("query_tiles"))
    tiles = F.broadcast(spark.createDataFrame(row_tiles.join(query_tiles, "cell").toArrow()))  # a row for each cell
    keys = ["cell", "row_tile", "query_tile"]

    def dealt(df: DataFrame, own: str, other: str, by: str, *more: str) -> DataFrame:
        df = df.join(tiles, "cell").withColumn(own, F.pmod(F.xxhash64(by), F.col(f"{own}s")).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select(*keys, by, *more)

    shared = spark.sparkContext.broadcast(model)

    def screen(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, out = key[0].as_py(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            own = shared.value
            codes = np.frombuffer(b"".join(right["codes"].to_pylist()), dtype=np.uint8).reshape(right.num_rows, -1)
            ids, error = right["id"].to_numpy(), right["error"].to_numpy()
            for name, query in zip(left["query_id"].to_pylist(), _units(left["vec"].combine_chunks(), own.dim)):
                far = own.distances(query, cell, codes)
                most, least = far + error, np.maximum(far - error, 0)
                if skip_same:
                    most = np.where(ids == name, np.inf, most)
                limit = np.partition(most, k - 1)[k - 1] if len(most) > k else np.inf
                hit = np.flatnonzero((least * least - 2 * _SLACK <= limit * limit + 1e-9) & ~(skip_same & (ids == name)))
                out.append((np.full(len(hit), name), ids[hit]))
        query, found = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": query, "cell": np.full(len(query), cell, dtype=np.int32), "id": found})

    left = dealt(probed, "query_tile", "row_tile", "query_id", "vec")
    right = dealt(held.select("cell", "id", "codes", "error"), "row_tile", "query_tile", "id", "codes", "error")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(screen, "query_id long, cell int, id long")


def _shelves(counts: dict[int, int]) -> tuple[dict[int, int], list[int]]:
    """The shelf of each cell, and the number of tiles of each shelf; a cell of more than ``SHELF_ROWS`` has a shelf of its own."""
    shelf, tiles, free = {}, [], 0
    for cell, count in sorted(counts.items()):
        if not tiles or count > free:
            tiles.append(-(-count // SHELF_ROWS))
            free = SHELF_ROWS
        free -= min(count, free)
        shelf[cell] = len(tiles) - 1
    return shelf, tiles


def _searched(model: Model, left: pa.Table, right: pa.Table, k: int, skip_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the best k of each query among the rows of its cells.

    Queries of one cell follow each other, so that the cells of a block of them are few if those of a query are.
    """
    right = right.sort_by("id")
    ids, (cells, place) = right["id"].to_numpy(), np.unique(right["cell"].to_numpy(), return_inverse=True)
    codes = np.frombuffer(b"".join(right["codes"].to_pylist()), dtype=np.uint8).reshape(right.num_rows, -1)
    rows, off = dense.unit(right["vec"], model.dim), right["error"].to_numpy().astype(np.float32)
    rounded, coded = rows.astype(np.float32), model.decoded(cells[place], codes).astype(np.float32)
    left = left.take(pa.array(np.argsort(_square(dense.unit(left["vec"], model.dim), model.cells[cells]).argmin(axis=1), kind="stable")))
    names, query, lists = left["query_id"].to_numpy(), dense.unit(left["vec"], model.dim), left["cells"].combine_chunks()
    asking, wanted = np.repeat(np.arange(left.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    asking, wanted = (x[np.isin(wanted, cells)] for x in (asking, wanted))
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step, by_codes = max(1, MOST_HELD // len(rows)), True
    for start in range(0, len(query), step):
        asked, own = query[start : start + step], slice(*np.searchsorted(asking, [start, start + step]))
        away = np.ones((len(asked), len(cells)), dtype=bool)
        away[asking[own] - start, np.searchsorted(cells, wanted[own])] = False
        seen = ~away.all(axis=0)
        here = np.flatnonzero(seen[place])
        pick = here if len(here) < len(rows) else slice(None)
        hidden = away[:, place[pick]] if away[:, seen].any() else None
        there, name = ids[pick], names[start : start + step]
        same = (np.searchsorted(there, name), np.searchsorted(there, name, "right")) if skip_same else None
        if by_codes:
            at, row = dense._left(asked, coded[pick], same, k, off[pick], hidden)
            by_codes = len(at) <= max(PAYS * len(asked) * len(here), 4 * k * len(asked))
        if not by_codes:
            at, row = dense._left(asked, rounded[pick], same, k, None, hidden)
        at, row, score = dense._scored(asked, rows, at, here[row], k)
        found.append((name[at], ids[row], score))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(index: Index, queries: DataFrame, k: int = 50, query_id: str = "query_id", vec_col: str = "embedding", skip_same: bool = False) -> DataFrame:
    """(query_id, child_id, score, ord): as ``dense.knn``, among the rows of the cells visited."""
    spark = queries.sparkSession
    if index.model is None:
        return spark.createDataFrame([], "query_id long, child_id long, score double, ord int")
    asked, model = dense.usable(queries, query_id, vec_col).where(F.size("vec") == index.model.dim), index.model
    shared = spark.sparkContext.broadcast(model)
    visited = _visited(asked, model)
    if not visited:
        return spark.createDataFrame([], "query_id long, child_id long, score double, ord int")
    held = index.entries.where(F.col("cell").isin(visited))
    shelf, tiles = _shelves({r.cell: r["count"] for r in held.groupBy("cell").count().collect()})
    count, tasks = asked.count(), 2 * spark.sparkContext.defaultParallelism
    query_tiles = max(1, -(-count // SHELF_QUERIES), min(-(-tasks // sum(tiles)), count // 256))  # a small table is cut finer, for all cores

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, vec, shelf, cells): each query with the cells within the margin, by shelf."""
        for part in (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE)):
            near = shared.value.excess(_units(part.column(1), shared.value.dim)) <= shared.value.margin
            for number in range(len(tiles)):
                own = np.array([c for c, s in shelf.items() if s == number])
                row, at = np.nonzero(near[:, own])
                asking, count = np.unique(row, return_counts=True)
                if len(asking):
                    cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(own[at], pa.int32()))
                    take = pa.array(asking)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.full(len(asking), number), pa.int32()), cells], names=["query_id", "vec", "shelf", "cells"])

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            names, ids, score = _searched(shared.value, left, right, k, skip_same)
        return pa.table({"query_id": names, "child_id": ids, "score": score})

    numbers = F.broadcast(spark.createDataFrame([(c, s, tiles[s]) for c, s in shelf.items()], "cell int, shelf int, row_tiles int"))  # a row for each cell
    keys = ["shelf", "row_tile", "query_tile"]
    left = asked.select("id", "vec").mapInArrow(each, "query_id long, vec array<double>, shelf int, cells array<int>").withColumn("query_tile", F.pmod(F.xxhash64("query_id"), F.lit(query_tiles)).cast("int"))
    left = left.join(numbers.select("shelf", "row_tiles").distinct(), "shelf").withColumn("row_tile", F.explode(F.sequence(F.lit(0), F.col("row_tiles") - 1)))
    right = held.join(numbers, "cell").withColumn("row_tile", F.pmod(F.xxhash64("id"), F.col("row_tiles")).cast("int")).withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    left, right = left.select(*keys, "query_id", "vec", "cells"), right.select(*keys, "cell", "id", "codes", "error", "vec")
    return top(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, child_id long, score double"), k)
