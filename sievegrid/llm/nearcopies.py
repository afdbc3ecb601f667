"""Groups of texts whose word shingles have a Jaccard similarity of at least ``SIMILARITY``, checked exactly.

Rows whose words are the same form one class and are compared once. Candidates come from two indexes. The SimHash
fingerprints of the classes go through the Gray-order index of ``simhash``, which finds the texts that hardly differ.
Texts at a similarity of 0.8 differ in a tenth to a quarter of a fingerprint's bits, which no index over bits can seek at
scale, so a class also has ``BANDS`` keys, each a hash of ``ROWS`` minima of its shingle hashes; classes that
share a key are candidates too. A pair counts only if the sets of 64-bit shingle hashes themselves are similar enough.

All pairs of a bucket of up to ``SMALL`` members are compared. In a larger one all members are compared with one of them,
the head, for up to ``STARS`` rounds with changing heads, so that like texts hang together at a cost that grows with
the bucket and not with its square. In a bucket that still holds several groups, the members outside its largest group are
compared with all its members, tile by tile: a task multiplies two tiles' incidence matrices and returns a spanning
forest of the links between groups, never the pairs. So only pairs that share no key are lost: 0.04 % of those at 0.8.

Defined results: words are parted at ASCII white space and lower-cased in A-Z; a text of fewer words than a shingle is
one shingle; null, empty and blank texts are one class; repeated rows are rows of one class; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.components import connected_components, forest
from sievegrid.llm.shared import Table, keep, scratch
from sievegrid.llm.simhash import MAX_BITS, bit_counts, majority, near_links

WORDS = 5
SIMILARITY = 0.8
#: Keys of a class, and minima in a key.
BANDS, ROWS = 20, 5
SEED = 42
SMALL, STARS = 16, 2
#: Members in a tile of those that are compared with all, and of all.
OPEN_TILE, TILE = 256, 1024
#: Numbers in an incidence matrix, about.
_CELLS = 1 << 21
#: Ids that are sent to the tasks; more are joined.
MOST_SENT = 1 << 20
_AT_ONCE = 512
_PIECE = 1 << 12
_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII spaces


def shingles(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included."""
    if not tokens:
        return np.zeros(0, dtype="<u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    own = zip(*(tokens[i:] for i in range(words))) if len(tokens) >= words else [tokens]
    return np.fromiter((digest(join(x), SEED) for x in own), dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    counts = sum((bit_counts(hashes[i : i + 8 * _PIECE]) for i in range(0, len(hashes), 8 * _PIECE)), np.zeros(64, dtype=np.int64))
    return majority(counts, len(hashes))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed long for each band; none for a text without words."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(hashes), _PIECE):
        np.minimum(least, (hashes[None, start : start + _PIECE] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE))


def _sketches(rows: DataFrame) -> DataFrame:
    """(row_id, text_key, fp, bands): text_key is the same for equal words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, prints, bands = [], np.zeros(batch.num_rows, dtype=np.uint64), []
            for i, text in enumerate(batch.column(1)):
                words = tokens_of(text.as_py())
                hashes = shingles(words)
                keys.append(hashlib.md5(b" ".join(words)).digest())
                prints[i] = fingerprint(hashes)
                bands.append(band_keys(np.unique(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(prints.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["row_id", "text_key", "fp", "bands"])

    return rows.select("row_id", "text").mapInArrow(each, "row_id long, text_key binary, fp long, bands array<long>")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, own) for the rows whose id is in ``wanted`` (row_id).

    Up to ``MOST_SENT`` ids are sent to the tasks, so that no text is moved; more are joined.
    """
    wanted = Table(wanted, "near-wanted").df
    sent = None
    if wanted.count() <= MOST_SENT:
        ids = np.sort(wanted.toArrow()["row_id"].to_numpy())  # 8 MB at most
        sent = rows.sparkSession.sparkContext.broadcast(ids)
    else:
        rows = rows.join(wanted, "row_id", "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if sent is not None:
                batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), sent.value)))
            sets = [np.unique(shingles(tokens_of(x.as_py()))).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])

    return rows.select("row_id", "text").mapInArrow(each, "node long, own array<long>")


def similar_rows(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """(i, j) of the sets of ``left`` and ``right`` that are similar enough, by products of incidence matrices."""
    many, start = np.array([len(x) for x in right], dtype=np.int64), 0
    while start < len(left):
        end, held = start + 1, len(left[start])
        while end < len(left) and (held + len(left[end])) * (end + 1 - start) <= _CELLS:
            held += len(left[end])
            end += 1
        part = left[start:end]
        names, at = np.unique(np.concatenate(part), return_inverse=True)
        own = np.zeros((len(part), len(names)), dtype=np.float32)
        own[np.repeat(np.arange(len(part)), [len(x) for x in part]), at] = 1
        step = max(1, _CELLS // max(1, len(names)))
        for low in range(0, len(right), step):
            others = right[low : low + step]
            flat = np.concatenate(others)
            place = np.searchsorted(names, flat)
            known = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == flat)
            theirs = np.zeros((len(names), len(others)), dtype=np.float32)
            theirs[place[known], np.repeat(np.arange(len(others)), many[low : low + step])[known]] = 1
            shared = own @ theirs  # whole numbers below 2 ** 24, so exact
            close = shared >= similarity * (np.array([len(x) for x in part])[:, None] + many[low : low + step] - shared.astype(np.float64))
            for i, j in np.argwhere(close).tolist():
                yield start + i, low + j
        start = end


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the (a, b) pairs that are similar enough, with a > b."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = pairs.join(sets.toDF("a", "own_a"), "a").join(sets.toDF("b", "own_b"), "b")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return both.where(shared >= similarity * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b")


class _Groups:
    """The links found so far and what they join."""

    def __init__(self, sets: DataFrame, similarity: float):
        self.sets, self.similarity = sets, similarity
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def _join(self, links: DataFrame) -> None:
        found = Table(links, "near-links").df
        self.links = found if self.links is None else self.links.unionByName(found)
        self.roots = connected_components(self.links)

    def compare(self, pairs: DataFrame) -> None:
        self._join(_similar(pairs, self.sets, self.similarity))

    def members(self, buckets: DataFrame) -> DataFrame:
        members = buckets.join(self.roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        return Table(members, "near-members").df

    def heads(self, members: DataFrame, turn: int) -> DataFrame:
        """(a, root, b, other): members that aren't joined with their bucket's head, which differs from turn to turn."""
        head = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("order"), F.col("node"), F.col("root")))
        heads = members.groupBy("key").agg(head.alias("head"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        heads = heads.select("key", F.col("head.node").alias("b"), F.col("head.root").alias("other"))
        return members.withColumnRenamed("node", "a").join(heads, "key").where("root <> other").select("a", "b")

    def settle(self, buckets: DataFrame) -> None:
        """Compares the members outside a bucket's largest group with all of it, tile by tile."""
        members = self.members(buckets)
        sized = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
        sized = sized.agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
        tiles = sized.select("key", "largest", F.ceil((F.col("n") - F.col("most")) / OPEN_TILE).cast("int").alias("open_tiles"), F.ceil(F.col("n") / TILE).cast("int").alias("all_tiles"))
        tiles = Table(tiles, "near-tiles").df
        rows = members.join(tiles, "key").join(self.sets, "node")

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            df = df.withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"{own}s")).cast("int"))
            df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            return df.select(*[F.col(c).alias(c) for c in ("key", "open_tile", "all_tile", "node", "root", "own")])

        similarity = self.similarity

        def link(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            if left.num_rows and right.num_rows:
                nodes, roots, sets = ([x[c] for x in (left, right)] for c in ("node", "root", "own"))
                nodes, roots = ([x.to_numpy() for x in both] for both in (nodes, roots))
                sets = [[x.values.to_numpy() for x in column] for column in sets]
                found = [(i, j) for i, j in similar_rows(*sets, similarity) if roots[0][i] != roots[1][j]]
                if found:
                    i, j = np.array(found).T
                    a, b = ([x] for x in forest(nodes[0][i], nodes[1][j]))
            return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

        keys = ["key", "open_tile", "all_tile"]
        left = dealt(rows.where("root <> largest"), "open_tile", "all_tile").groupBy(*keys)
        self._join(left.cogroup(dealt(rows, "all_tile", "open_tile").groupBy(*keys)).applyInArrow(link, "a long, b long"))


def groups(rows: DataFrame, similarity: float = SIMILARITY, small: int = SMALL, stars: int = STARS) -> DataFrame:
    """(row_id, group_id) for each row of (row_id, text); row ids are unique, the group's id is one of them."""
    with scratch():
        sketches = keep(Table(_sketches(rows), "near-sketches")).df
        classes = Table(sketches.groupBy("text_key").agg(F.min("row_id").alias("node"), F.min("fp").alias("fp")), "near-classes").df  # equal words have equal fingerprints
        dealt = sketches.join(classes.select(F.col("node").alias("row_id")), "row_id", "left_semi")
        dealt = Table(dealt.select(F.explode("bands").alias("key"), F.col("row_id").alias("node")), "near-bands")
        shared = dealt.df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        buckets = Table(dealt.df.join(shared, "key").select("key", "node", "n"), "near-buckets").df
        dealt.drop()

        prints = Table(classes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints").df
        same = classes.join(prints, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        near = near_links(prints.select("fp"), MAX_BITS)
        near = near.join(prints.toDF("a", "first_a"), "a").join(prints.toDF("b", "first_b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
        pairs = Table(same.union(near), "near-candidates").df

        wanted = buckets.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct().withColumnRenamed("node", "row_id")
        found = _Groups(Table(_sets(rows, wanted), "near-sets").df, similarity)
        few, large = buckets.where(F.col("n") <= small).select("key", "node"), buckets.where(F.col("n") > small).select("key", "node")
        each = few.toDF("key", "a").join(few.toDF("key", "b"), "key").where("a > b").select("a", "b")
        first = found.heads(large.withColumn("root", F.col("node")), 0)
        found.compare(pairs.union(each).union(first))
        if not large.isEmpty():
            found.sets = Table(found.sets.join(large.select("node").distinct(), "node", "left_semi"), "near-sets").df
            for turn in range(1, stars):
                found.compare(found.heads(found.members(large), turn))
            found.settle(large)
        named = classes.join(found.roots, "node", "left").select("text_key", F.coalesce("root", "node").alias("group_id"))
        named = keep(Table(named, "near-named")).df
    return sketches.select("row_id", "text_key").join(named, "text_key").select("row_id", "group_id")
