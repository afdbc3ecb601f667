"""Embedding near-duplicates through an inverted multi-index.

Each half of a vector has its own codebook, so a pair of centroids is a cell of a grid. Every vector is
listed in the cell nearest to it, and sought in its nearest cells in rising order of distance (the multi-sequence
order): it goes on until a cell is further than its own by more than a margin. The margin is measured while
fitting: so many of the hardest partners, those at exactly the threshold in random directions, have their own cell
within it. A pair is found if either vector is sought in the other's cell; every pair found is verified by its cosine.

The codebooks grow with the table, up to ``MOST_CENTROIDS`` each (a million cells); beyond about 33 million different vectors
cells grow instead. They are fitted on ``SAMPLE`` vectors, or ``PER_CENTROID`` for each centroid if that is more (32,768
at most), and everything else covers all rows. With a ``recall`` of 1 there is one cell, so that the search is exact: all
tiles meet all tiles. Equal vectors are one entry with
a weight. A cell's entries and those sought in it are cut into tiles; a task takes one tile of each, multiplies
them block by block, and returns counts and a spanning forest of its links, never the pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or whose ``vec_id`` is
null, links with nothing and is its own component; vectors of different lengths never link; rows that share an id
count as one node; repeated rows link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.components import connected_components
from sievegrid.llm.shared import Table, read_table

THRESHOLD = 0.95
RECALL = 0.99
SAMPLE, PER_CENTROID = 4096, 32
SEED = 23
#: Vectors in a cell, about, while the codebooks may still grow; centroids in a codebook at most.
CELL_ROWS, MOST_CENTROIDS = 32, 1024
TILE = 4096
#: Rows that a task works on at a time, and pairs of them: of a large group of near copies every pair is a link.
_BLOCK, _PAIRS = 1024, 1 << 20


def _square(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)


def _centroids(rows: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = _square(rows, centres).argmin(1)
        held = np.bincount(own, minlength=len(centres))
        for axis in range(rows.shape[1]):
            total = np.bincount(own, weights=rows[:, axis], minlength=len(centres))
            centres[:, axis] = np.where(held > 0, total / np.maximum(held, 1), centres[:, axis])
    return centres


class Grid:
    """Two codebooks and the margin of the search."""

    def __init__(self, sample: np.ndarray, count: int, threshold: float, recall: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = _centroids(sample[:, : self.half], count, rng), _centroids(sample[:, self.half :], count, rng)
        across = rng.normal(size=sample.shape)
        across -= (across * sample).sum(1)[:, None] * sample
        across /= np.maximum(np.linalg.norm(across, axis=1), 1e-300)[:, None]
        partner = self.home(threshold * sample + np.sqrt(1 - threshold * threshold) * across)
        self.margin = float(np.quantile(self.excess(self.distances(sample), partner), recall)) + 1e-12

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _square(unit[:, : self.half], self.books[0]), _square(unit[:, self.half :], self.books[1])

    def home(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def excess(self, apart: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
        """How much further than its nearest cell each row's given cell is."""
        a, b = apart
        left, right = np.divmod(cells, len(self.books[1]))
        each = np.arange(len(cells))
        return a[each, left] + b[each, right] - a.min(1) - b.min(1)

    def nearest(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Cells of one row in rising order of distance, by the multi-sequence algorithm, up to the margin."""
        first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        limit = a[first[0]] + b[second[0]] + self.margin
        heap, taken = [(a[first[0]] + b[second[0]], 0, 0)], {(0, 0)}
        while heap:
            far, i, j = heapq.heappop(heap)
            if far > limit:
                return
            yield int(first[i]) * len(second) + int(second[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(first) and y < len(second) and (x, y) not in taken:
                    taken.add((x, y))
                    heapq.heappush(heap, (a[first[x]] + b[second[y]], x, y))


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of unit length, zeros behind, and their own lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets, dtype=np.int64))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    top = np.abs(out).max(axis=1, initial=0)
    out = np.ldexp(out, -np.frexp(top)[1][:, None])  # exact, and keeps squares in range
    return out / np.linalg.norm(out, axis=1)[:, None], sizes


def tile_links(grid: Grid, ids: tuple[np.ndarray, np.ndarray], units: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], weights: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[dict[int, int], dict[int, int]]:
    """For entries sought in a cell (0) and entries listed there (1): links by id, and a root for each linked id.

    A listed entry that is itself sought in the other's cell counts the link there, not here.
    """
    names, where = np.unique(np.concatenate(ids), return_inverse=True)
    root, total = np.arange(len(names)), np.zeros(len(names), dtype=np.int64)
    near, home = grid.distances(units[1]), np.divmod(grid.home(units[0]), len(grid.books[1]))
    limit = near[0].min(1) + near[1].min(1) + grid.margin
    step = max(1, min(_BLOCK, _PAIRS // max(1, len(ids[1]))))
    for start in range(0, len(ids[0]), step):
        rows = slice(start, start + step)
        close = units[0][rows] @ units[1].T >= threshold
        close &= (sizes[0][rows, None] == sizes[1]) & (ids[0][rows, None] != ids[1])
        seek, listed = np.nonzero(close)
        if not len(seek):
            continue
        seek += start
        back = near[0][listed, home[0][seek]] + near[1][listed, home[1][seek]] > limit[listed]  # a number of each codebook for each pair, not whole rows
        a, b = where[seek], where[len(ids[0]) + listed]
        for at, n in ((a, weights[1][listed]), (b[back], weights[0][seek[back]])):
            total += np.bincount(at, weights=n, minlength=len(names)).astype(np.int64)
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    counted = np.flatnonzero(total)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return dict(zip(names[counted].tolist(), total[counted].tolist())), dict(zip(names[moved].tolist(), names[root[moved]].tolist()))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, centroids: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row; ``centroids`` by default follow the table's size."""
    spark = rows.sparkSession
    kind = "float" if "float" in rows.select(vec_col).schema[0].dataType.simpleString() else "double"  # floats travel as floats; all sums are in double precision
    vec = F.transform(F.col(vec_col), lambda x: x.cast(kind))
    sound = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    every = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    every = Table(every.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec")), "vectors").df
    good = every.where("sound")
    entries = good.groupBy("h1", "h2").agg(F.min("id").alias("entry"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    entries = Table(entries, "entries").df
    size = entries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    alone = every.where("NOT sound").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not size.n:
        return alone.withColumn("kept", F.lit(True))

    width = size.dim + size.dim % 2
    centroids = 1 if recall >= 1 else centroids or int(min(MOST_CENTROIDS, max(1, round((size.n / CELL_ROWS) ** 0.5))))
    sample = entries.orderBy("h1", "h2").limit(max(SAMPLE, PER_CENTROID * centroids)).select("vec").toArrow()  # bounded by ``MOST_CENTROIDS``
    grid = Grid(_padded(sample["vec"], width)[0], centroids, threshold, recall)
    shared = spark.sparkContext.broadcast(grid)  # two codebooks of ``MOST_CENTROIDS`` at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                unit, _ = _padded(part.column(2), width)
                a, b = grid.distances(unit)
                cells = [list(grid.nearest(x, y)) for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(grid.home(unit)), pa.array(cells, pa.list_(pa.int64()))], names=["entry", "weight", "vec", "home", "cells"])

    placed = Table(entries.select("entry", "weight", "vec").mapInArrow(assign, f"entry long, weight long, vec array<{kind}>, home long, cells array<long>"), "placed").df
    listed = placed.select("entry", "weight", "vec", F.col("home").alias("cell"))
    sought = placed.select("entry", "weight", "vec", F.explode("cells").alias("cell"))
    tiles = listed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("listed_tiles"))
    tiles = tiles.join(placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("sought_tiles")), "cell")
    tiles = Table(tiles, "cell-tiles").df

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(tiles, "cell").withColumn(own, F.pmod(F.xxhash64("entry"), F.col(f"{own}s")).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return df.select(*[F.col(c).alias(c) for c in ("cell", "listed_tile", "sought_tile", "entry", "weight", "vec")])  # new names: both sides come from one table

    def link(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int | None]] = []
        if left.num_rows and right.num_rows:
            units, sizes = zip(*(_padded(x["vec"], width) for x in (left, right)))
            ids, weights = ([x[c].to_numpy() for x in (left, right)] for c in ("entry", "weight"))
            counts, roots = tile_links(shared.value, tuple(ids), units, sizes, tuple(weights), threshold)
            found = [(name, roots.get(name, name), n) for name, n in counts.items()] + [(name, to, 0) for name, to in roots.items() if name not in counts]
        return pa.table({k: pa.array([x[i] for x in found], pa.int64()) for i, k in enumerate(("a", "b", "n"))})

    keys = ["cell", "listed_tile", "sought_tile"]
    left, right = dealt(sought, "sought_tile", "listed_tile"), dealt(listed, "listed_tile", "sought_tile")
    links = Table(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(link, "a long, b long, n long"), "vector-links").df
    counts = links.groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("n"))
    nodes = connected_components(links.select("a", "b")).withColumnRenamed("node", "entry")
    known = entries.select("h1", "h2", "entry", "weight").join(counts, "entry", "left").join(nodes, "entry", "left")
    known = Table(known.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "entry").alias("root")), "vector-classes").df
    out = good.join(known, ["h1", "h2"]).select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("root").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_multiindex(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
