"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints are computed document by document, then reduced to distinct values. Any two values that
differ in at most ``MAX_BITS`` bits agree on at least one of ``MAX_BITS + 1`` blocks of bits, so each value is
dealt to one group per block. A group that is still large is dealt again by blocks of the bits not yet fixed,
until it is small or so few free bits remain that it can hold no more than ``2 ** free`` values: no group grows
with the input. Within a group the values are sorted by Gray rank and a tree is built over them whose upper
nodes hold the bit patterns that all values below share. A search goes down the tree level by level for all
values at once, adds up the differing bits and drops a whole branch once they exceed the limit.

Defined results: a null or empty text has fingerprint zero, which links like any other; a null ``doc_id`` is kept,
gets its component's smallest ``doc_id`` and is never that smallest one (null if no row of the component has an
id); repeated rows come back as often as given; an empty table gives an empty result; other columns are ignored. A task
holds the words of one text at a time, and the hashes of ``_PIECE`` of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.components import connected_components
from sievegrid.llm.shared import Table, keep, scratch

MAX_BITS = 3
WORDS = 3
SEED = 42
#: Values in a group above which it is dealt again by further bits.
LARGE_GROUP = 2048
#: Free bits at which a group is not split further; it can hold 2 ** 15 values at most.
FEW_BITS = 15
_PIECE = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the whole text over its word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII spaces
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    digest, join, total = xxhash.xxh64_intdigest, b" ".join, len(tokens) - words + 1
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, total, _PIECE):
        part = tokens[start : start + _PIECE + words - 1]
        counts += bit_counts(np.array([digest(join(x), SEED) for x in zip(*(part[i:] for i in range(words)))], dtype="<u8"))
    return majority(counts, total)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, total: int) -> int:
    """The fingerprint: bits that are set in over half of ``total`` hashes."""
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row per document; fp holds the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the order of the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over distinct 64-bit values in Gray order; each node holds what its parent doesn't of the shared bits."""

    FANOUT = 8

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        everything = np.uint64(0xFFFFFFFFFFFFFFFF)
        shared, pattern = [np.full(len(values), everything)], [self.values]
        while len(pattern[-1]) > 1:
            starts = np.arange(0, len(pattern[-1]), self.FANOUT)
            ones = np.bitwise_and.reduceat(pattern[-1] | ~shared[-1], starts)
            zeros = np.bitwise_or.reduceat(pattern[-1] & shared[-1], starts)
            agree = np.bitwise_and.reduceat(shared[-1], starts) & (ones | ~zeros)
            shared.append(agree)
            pattern.append(pattern[-1][starts] & agree)
        self.shared, self.pattern = shared[::-1], pattern[::-1]  # from the root down
        self.own = [self.shared[0]]
        for upper, lower in zip(self.shared, self.shared[1:]):
            self.own.append(lower & ~np.repeat(upper, self.FANOUT)[: len(lower)])

    def links(self, limit: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions at most ``limit`` bits apart, later one first, for a block of values at a time.

        A branch whose values must all lie within the limit of the value sought, and of each other, is
        answered by its first value alone; the pairs then connect the same values with fewer of them.
        """
        last = len(self.own) - 1
        for start in range(0, len(self.values), block):
            sought = np.arange(start, min(start + block, len(self.values)))
            node, diff = np.zeros(len(sought), dtype=np.int64), np.zeros(len(sought), dtype=np.int64)
            for level in range(last + 1):
                if level:
                    child = (node[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                    sought, diff = np.repeat(sought, self.FANOUT), np.repeat(diff, self.FANOUT)
                    width = self.FANOUT ** (last - level)
                    keep = (child < len(self.own[level])) & (child * width < sought)
                    node, sought, diff = child[keep], sought[keep], diff[keep]
                apart = (self.values[sought] ^ self.pattern[level][node]) & self.own[level][node]
                diff = diff + np.bitwise_count(apart)
                keep = diff <= limit
                node, sought, diff = node[keep], sought[keep], diff[keep]
                if level < last:
                    free = 64 - np.bitwise_count(self.shared[level][node]).astype(np.int64)
                    width = self.FANOUT ** (last - level)
                    whole = (diff + free <= limit) & ((node + 1) * width <= sought)
                    if whole.any():
                        yield sought[whole], node[whole] * width
                        node, sought, diff = node[~whole], sought[~whole], diff[~whole]
            yield sought, node
        for level in range(last):  # values that a whole branch stood for hang together
            free = 64 - np.bitwise_count(self.shared[level]).astype(np.int64)
            for at in np.flatnonzero(free <= limit):
                width = self.FANOUT ** (last - level)
                members = np.arange(at * width + 1, min((at + 1) * width, len(self.values)))
                yield members, np.full(len(members), at * width)


def linked(values: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its group) for the values that have a link, by the index; values are distinct."""
    if len(values) < 2:
        return values[:0], values[:0]
    index = GrayIndex(values)
    root = np.arange(len(values))
    for a, b in index.links(limit):
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (further := root[root] != root).any():
                root = np.where(further, root[root], root)
    touched = np.bincount(root, minlength=len(root))[root] > 1
    return index.values[touched], index.values[root[touched]]


def _parts(bits: list[int], count: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), count)]


def near_links(values: DataFrame, limit: int = MAX_BITS, large: int = LARGE_GROUP) -> DataFrame:
    """(a, b) with a > b: links that connect all distinct values ``fp`` at most ``limit`` bits apart."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (fp, fixed) with fixed the bits that the group shares: one row per block of the other bits."""
        blocks: dict[int, list[int]] = {}
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fixed = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in np.unique(fixed).tolist():
                if mask not in blocks:
                    free = [i for i in range(64) if not mask >> i & 1]
                    blocks[mask] = [mask | sum(1 << i for i in part) for part in _parts(free, limit + 1)]
                own = fp[fixed == mask]
                for wider in blocks[mask]:
                    masks = np.full(len(own), wider, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (own, masks, own & masks)], names=["fp", "fixed", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; one group is held at a time."""
        held: list[np.ndarray] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = linked(np.unique(np.concatenate(held)), limit)
                if (apart := a != b).any():
                    high, low = np.maximum(a.view(np.int64), b.view(np.int64))[apart], np.minimum(a.view(np.int64), b.view(np.int64))[apart]
                    yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["a", "b"])

        for batch in batches:
            fp, fixed, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(fixed) != 0) | (np.diff(part) != 0)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(fp)]):
                if start == end:
                    continue
                if key != (now := (int(fixed[start]), int(part[start]))):
                    yield from close()
                    held, key = [], now
                held.append(fp[start:end].view(np.uint64).copy())
        yield from close()

    todo = values.select("fp", F.lit(0).cast("long").alias("fixed"))
    found: DataFrame | None = None
    depth, free = 0, 64
    tables: list[Table] = []
    while True:
        depth, free = depth + 1, free - free // (limit + 1)
        dealt = Table(todo.mapInArrow(deal, "fp long, fixed long, part long"), "simhash-dealt")
        tables.append(dealt)
        sizes = dealt.df.groupBy("fixed", "part").agg(F.count("*").alias("n")).where("n > 1")
        small = dealt.df.join(sizes.where(F.col("n") <= large).select("fixed", "part"), ["fixed", "part"], "left_semi") if free > FEW_BITS else dealt.df
        near = small.select("fp", "fixed", "part").repartition("fixed", "part").sortWithinPartitions("fixed", "part").mapInArrow(search, "a long, b long")
        out = Table(near.distinct(), "simhash-links")
        found = out.df if found is None else found.unionByName(out.df)
        if free <= FEW_BITS:
            break
        hot = sizes.where(F.col("n") > large).select("fixed", "part")
        if hot.isEmpty():
            break
        todo = Table(dealt.df.join(hot, ["fixed", "part"], "left_semi").select("fp", "fixed"), "simhash-hot").df
    for table in tables:
        table.drop()
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; see the module for the defined results."""
    with scratch():
        prints = keep(Table(fingerprints(docs, id_col, text_col, words), "simhash-prints")).df
        values = Table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-values").df
        nodes = connected_components(near_links(values, limit))
        own = values.join(nodes.select(F.col("node").alias("fp"), "root"), "fp", "left")
        own = own.withColumn("root", F.coalesce("root", "fp"))
        first = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
        classes = keep(Table(own.join(first, "root").select("fp", "component_id"), "simhash-classes")).df
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
