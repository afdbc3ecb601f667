"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Texts are tokenised and cut in one pass over the documents. How pieces can be packed depends only on how many
there are of each length, and there are at most ``CAPACITY`` lengths: that histogram is all the driver sees, and
whatever the number of documents it plans with multiplicities. The reduction fixes sets that provably belong to
some best packing: a piece that no other fits beside, a pair that fills a sequence, and a pair or a triple that beats every
other set with its longest piece. A set is fixed as often as its pieces last, so that every step uses up a length
and the plan has at most a few rows for each length. What is left is packed best-fit, longest first. The plan says which ranks among
the pieces of a length go to which sequences; ranks are counted in small hashed parts of each length, so a length
that a third of all pieces share is not gathered in one task.

Defined results: a null or empty text is a document of the end id alone; a null id is kept; repeated rows are packed
once each; an empty table gives an empty result; other columns are ignored. A task holds the ids of one text at a time,
4 bytes for each, and while it splits the text, its words.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.llm.shared import Table, read_table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces in one hashed part of a length, about.
PART_ROWS = 50_000
#: Entries that a task's memory of words may hold.
MEMORY = 150_000

#: Anything but plain Latin characters, whose kinds both regular-expression engines see alike (not so for ², ½ or the dotless i).
_PLAIN = re.compile("[^\t\n\r -~¡-¬®-±´-¸º»¿-įĲ-ɏ]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


class _Known(dict):
    """Bytes of ids by key, worked out when first seen and kept while there is room."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, key):
        found = self.find(key)
        if len(self) < MEMORY:
            self[key] = found
        return found


# The parts of a tokeniser's configuration that the look-up of words relies on.
SPLIT_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    A tokeniser that is configured as ``SPLIT_BY_WORDS`` splits a text at white space and then into words that it encodes
    one by one, so for texts of plain Latin characters the ids of a white-space run are looked up. All other texts, those
    that may hold the string of a special token, and all texts of other tokenisers go to the tokeniser whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.by_words = all(settings[k] == v for k, v in SPLIT_BY_WORDS.items()) and settings["model"]["type"] == "BPE" and settings["model"]["dropout"] is None
        self.by_words = self.by_words and all(x["content"].startswith("<|") and not x["normalized"] for x in settings["added_tokens"])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves
        table = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
        model = self.tokenizer.model

        def word(x: str) -> bytes:
            spelled = x if x.isascii() else "".join(table[b] for b in x.encode())
            return np.array([t.id for t in model.tokenize(spelled)], dtype="<u4").tobytes()

        words = _Known(word)
        self.runs = _Known(lambda x: b"".join(map(words.__getitem__, _WORD.findall(x))))

    def __call__(self, text: str) -> bytes:
        if not self.by_words or "<|" in text or _PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.runs.__getitem__, text.lower().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut where longer than ``capacity``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[tuple] = []
            for doc, text in zip(ids, texts):
                data = memoryview(encode(text.as_py() or "") + end)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(part) // 4, crc32(part)))
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # (length, how many) in one sequence


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets that some best packing holds, with how often, and the counts that are left.

    For a piece j of the longest left and the longest k that fits beside it, {j, k} dominates every set with j if
    it is full, or if no set of two or more fits beside j with more than k's length. Where two but not three pieces
    fit beside j, {j, k, b} with the longest b that fits dominates them if of any two with the shorter one longer than b,
    the sum is at most k. Pieces that go only make these conditions easier, so a set is taken while its pieces last.
    """
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(*members: int) -> None:
        times = {s: members.count(s) for s in dict.fromkeys(members)}
        n = min(left[s] // k for s, k in times.items())
        fixed.append((tuple(times.items()), n))
        for s, k in times.items():
            left[s] -= n * k
            if not left[s]:
                del left[s]
                sizes.remove(s)

    def smallest(without: int, n: int) -> list[int]:
        """Up to n smallest pieces besides one of ``without``."""
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), left[s] - (s == without))
            if len(out) == n:
                break
        return out

    def longest(room: int, *taken: int) -> int:
        """The longest piece of at most ``room`` besides those that are taken, 0 if there is none."""
        at = bisect_left(sizes, room + 1) - 1
        while at >= 0 and left[sizes[at]] <= taken.count(sizes[at]):
            at -= 1
        return sizes[at] if at >= 0 else 0

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                low = smallest(j, 3)
                if not low or low[0] > room:
                    take(j)
                    changed = True
                    continue
                k = longest(room, j)
                if k == room or len(low) < 2 or low[0] + low[1] > room:
                    take(j, k)
                elif len(low) == 3 and sum(low) <= room:
                    break
                elif _longest_pair(sizes, left, j, room) <= k:
                    take(j, k)
                elif (b := longest(room - k, j, k)) and _longest_pair(sizes, left, j, room, b) <= k:
                    take(j, k, b)
                else:
                    break
                changed = True
    return fixed, left


def _longest_pair(sizes: list[int], left: dict[int, int], j: int, room: int, above: int = 0) -> int:
    """The longest two pieces, both longer than ``above``, that fit beside j together, 0 if none do."""
    sizes = [s for s in sizes if s > above and left[s] > (s == j)]
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        a, b = sizes[low], sizes[high]
        if a + b > room:
            high -= 1
            continue
        if a != b or left[a] - (a == j) >= 2:
            best = max(best, a + b)
        low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the open sequence with the least room that takes it; equal sequences move together."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, room: int, n: int) -> None:
        if not n:
            return
        if not room:
            done.append((pattern, n))
            return
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((pattern, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern, many = capacity, (), n
            each = room // s
            whole = min(many, n // each)
            put((*pattern, (s, each)), room - each * s, whole)
            n, many = n - whole * each, many - whole
            if n and many:
                put((*pattern, (s, n)), room - n * s, 1)
                n, many = 0, many - 1
            if pattern:
                put(pattern, room, many)
    return done + [x for groups in open_.values() for x in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, how many in each sequence, offset of the first), by first rank."""
    fixed, left = reduce_by_dominance(counts, capacity)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, n in fixed + best_fit(left, capacity):
        offset = 0
        for s, each in pattern:
            rows.setdefault(s, []).append((ranks[s], sequence, each, offset))
            ranks[s] += n * each
            offset += s * each
        sequence += n
    return {s: np.array(x, dtype=np.int64) for s, x in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces (doc_id, piece, start, length, ids_crc32)."""
    counts = {x.length: x.n for x in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``capacity`` rows at most
    places = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    parts = max(1, -(-sum(counts.values()) // PART_ROWS))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(sizes.select("length", "part", before.alias("before")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for s in np.unique(length).tolist():
                at = np.flatnonzero(length == s)
                rows = known[s][np.searchsorted(known[s][:, 0], rank[at], side="right") - 1]
                place_in, slot = np.divmod(rank[at] - rows[:, 0], rows[:, 2])
                sequence[at], offset[at] = rows[:, 1] + place_in, rows[:, 3] + slot * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return pack(Table(pieces(docs, tokenizer, capacity=capacity), "pieces").df, capacity)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
