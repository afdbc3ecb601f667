"""Which texts hold which questions word for word, by an equality join on a window that both must share.

Every window of some bytes is hashed, and the smallest hash of each run of neighbouring windows is a mark. A text that
holds a question holds its runs too, so each mark of the question is one of the text's: a question is known by one of
them, a text by all of its own, about two in a run. The join gives candidates, and each is verified on the
texts themselves. Questions too short for a run of the widest windows are known by narrower ones, and those of up to 8 bytes by
a window of just their length, so that only texts that hold it meet it. Texts are marked for those widths only that
some question needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window and windows of a run (a power of two), from the widest on; empty questions have none.
LEVELS = ((32, 32), (8, 8), *((window, 1) for window in range(8, 0, -1)))
_PIECE = 1 << 22
#: Bytes of texts that are marked together; a longer text is marked alone.
_STRETCH = 1 << 15
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(data: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all windows."""
    h = data.astype(np.uint64) + np.uint64(1)
    width, power = 1, _BASE
    while width < window:  # the hash of a window from those of its halves, which overlap where it is no power of two
        step = min(width, window - width)
        h = h[:-step] * power + h[step:]
        width, power = width + step, np.uint64(int(power) ** 2 % 2**64)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, run: int) -> np.ndarray:
    """The smallest of each run of neighbours."""
    width = 1
    while width < run:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    """Sorted; much faster than ``np.unique``."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])[: len(h)]]


def marks(data: np.ndarray, window: int, run: int) -> np.ndarray:
    """Sorted distinct hashes that are the smallest of a run of windows of a whole text, piece by piece."""
    found = [np.zeros(0, dtype=np.uint64)]
    for start in range(0, max(len(data) - window - run + 2, 0), _PIECE):
        found.append(_distinct(_least(_hashes(data[start : start + _PIECE + window + run - 2], window), run)))
    return _distinct(np.concatenate(found))


def marks_of_many(data: np.ndarray, start: np.ndarray, size: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, mark) of short texts that lie one after the other in ``data``, sorted and distinct, as ``marks`` gives them for each.

    All are hashed at once; runs that are not within one text are left out.
    """
    if len(size) == 1:
        found = marks(data[start[0] : start[0] + size[0]], window, run)
        return np.zeros(len(found), np.int64), found
    count = np.maximum(size - (window + run - 2), 0)
    if not count.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(text)) + (start - np.cumsum(count) + count)[text]
    mark = _least(_hashes(data, window), run)[at]
    new = np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))  # neighbouring runs mostly have the same mark
    text, mark = text[new], mark[new]
    order = np.argsort(mark)
    order = order[np.argsort(text[order], kind="stable")]
    text, mark = text[order], mark[order]
    new = np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))
    return text[new], mark[new]


def _level(size: int) -> int:
    """The first level at which a question of so many bytes has a run."""
    return next((i for i, (window, run) in enumerate(LEVELS) if size >= window + run - 1), len(LEVELS))


def mark_batches(batches: Iterator[pa.RecordBatch], levels: list[int] | None) -> Iterator[pa.RecordBatch]:
    """(id, level, mark) of (id, text): all marks of a text at the given levels, or one mark of a question at its own level.

    Texts are taken together, in stretches of about as many bytes, as most texts of a corpus may be short.
    """
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        _, offsets, held = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            past = max(first + 1, int(np.searchsorted(ends, ends[first] + _STRETCH, "right")) - 1)
            past = min(past, first + _STRETCH)  # empty texts have no bytes
            start, size = ends[first:past] - ends[first], np.diff(ends[first : past + 1])
            near, found = data[ends[first] : ends[past]], []
            own = None if levels is not None else np.array([_level(x) for x in size])
            for level in levels if levels is not None else sorted({*own.tolist()} - {len(LEVELS)}):
                text, mark = marks_of_many(near, start, size if own is None else np.where(own == level, size, 0), *LEVELS[level])
                if own is not None:  # the smallest one
                    once = np.append(True, text[1:] != text[:-1])[: len(text)]
                    text, mark = text[once], mark[once]
                found.append((text, np.full(len(text), level, np.int32), mark))
            if found:
                text, level, mark = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + text)), pa.array(level), pa.array(mark.view(np.int64))], names=["id", "level", "mark"])
            first = past


def _marked(rows: DataFrame, levels: list[int] | None) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(lambda batches: mark_batches(batches, levels), f"id {kind}, level int, mark long")


def candidates(asked: DataFrame, held: DataFrame, levels: list[int]) -> DataFrame:
    """(a, b): each question, by the mark it is known by, with each text that has this mark; both are (id, text)."""
    known = _marked(asked, None).withColumnRenamed("id", "a")
    return _marked(held, levels).withColumnRenamed("id", "b").join(known, ["level", "mark"]).select("a", "b").distinct()


def containing(asked: DataFrame, held: DataFrame, asked_id: str = "query_id", held_id: str = "child_id", text_col: str = "text") -> DataFrame:
    """(asked_id, held_id): each question with each text that holds it; questions' ids are unique, a text's id may stand for copies.

    A null text holds nothing and is held by nothing; an empty question is held by every text that isn't null.
    """
    left, right = (df.select(F.col(i).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL") for df, i in ((asked, asked_id), (held, held_id)))
    size = F.octet_length("text")
    level = F.lit(len(LEVELS))
    for i, (window, run) in reversed(list(enumerate(LEVELS))):
        level = F.when(size >= window + run - 1, i).otherwise(level)
    levels = sorted(x.level for x in left.select(level.alias("level")).distinct().collect())  # one for each of ``LEVELS`` at most
    empty, left = left.where(size == 0), left.where(size > 0)
    pairs = candidates(left, right, [x for x in levels if x < len(LEVELS)])
    questions, texts = left.select(F.col("id").alias("a"), F.col("text").alias("asked")), right.select(F.col("id").alias("b"), F.col("text").alias("held"))
    sure = pairs.join(questions, "a").join(texts, "b").where(F.contains("held", F.col("asked")))
    if len(LEVELS) in levels:  # every text holds them, so they are listed beside each one
        each = empty.agg(F.collect_list("id").alias("ids")).scalar()
        sure = sure.select("a", "b").unionByName(right.select(F.explode(each).alias("a"), F.col("id").alias("b")))
    return sure.select(F.col("a").alias(asked_id), F.col("b").alias(held_id))
