"""What a chat session remembers: its last texts, until it is cleared or its time is over, in batches and in streams alike.

Turns are (session_id, at, seq, text, clears). A session begins with its first text, forgets all when a row with ``clears``
comes, and is over ``ttl`` after it began, however busy it is; a later text begins it anew. Rows of a session are taken in
the order of (at, seq). Result: (session_id, began, n, history), one row for each beginning: how many texts it took, and the last
``keep`` of them joined by line feeds.

Null session ids and times take no part, a null text is an empty one, a null ``clears`` is false, a null ``seq`` is 0. Rows that
are equal in all of (session_id, at, seq) are ordered by a hash of their text. Other columns are left aside. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEEP = 20
TTL_SECONDS = 3600
MEMORY = "session_id long, began timestamp, n long, history string"


def turns_of(rows: DataFrame) -> DataFrame:
    """The columns that count, with defined values."""
    text, clears = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("clears", F.lit(False)).alias("clears")
    kept = rows.where("session_id IS NOT NULL AND at IS NOT NULL").select("session_id", "at", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), text, clears)
    return kept.withColumn("us", F.unix_micros("at")).withColumn("hash", F.xxhash64("text"))


FOLDED = "session_id long, us long, seq long, hash long, began long, place long"


def _places(batches: Iterator[pd.DataFrame], ttl_us: int) -> Iterator[pd.DataFrame]:
    """Adds to each text of sorted rows when its session began and its place there; one session's numbers are carried on."""
    session, began, place = None, None, 0
    for batch in batches:
        ids, times, clears = (batch[c].to_numpy() for c in ("session_id", "us", "clears"))
        out = np.zeros((len(batch), 2), dtype="int64")
        for i in range(len(batch)):
            if ids[i] != session or clears[i]:
                session, began = ids[i], None
            if clears[i]:
                continue
            if began is None or times[i] - began > ttl_us:
                began, place = times[i], 0
            place += 1
            out[i] = began, place
        kept = batch.drop(columns="clears").assign(began=out[:, 0], place=out[:, 1])
        yield kept[~clears.astype(bool)]


def session_memory(rows: DataFrame, keep: int = KEEP, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Of a whole table. When a session began depends on all its rows before, so one task reads a session's times in order, as a
    stream of which it holds one row; no texts go there. Texts meet the last places by the whole row's key, which no busy session makes hot."""
    turns = turns_of(rows)
    narrow = turns.select("session_id", "us", "seq", "hash", "clears")
    ordered = narrow.repartition("session_id").sortWithinPartitions("session_id", "us", "seq", "hash")
    ttl_us = ttl_seconds * 1_000_000
    found = ordered.mapInPandas(lambda batches: _places(batches, ttl_us), FOLDED)
    back = F.row_number().over(W.partitionBy("session_id", "began").orderBy(F.desc("place")))
    last = found.withColumn("back", back).where(F.col("back") <= keep)
    texts = turns.where("NOT clears").select("session_id", "us", "seq", "hash", "text").distinct()
    lines = F.array_sort(F.collect_list(F.struct("place", "text")))
    joined = last.join(texts, ["session_id", "us", "seq", "hash"]).groupBy("session_id", "began").agg(F.max("place").alias("n"), lines.alias("lines"))
    history = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return joined.select("session_id", F.timestamp_micros("began").alias("began"), "n", history.alias("history"))


class Memory(StatefulProcessor):
    """A session's beginning, number of texts and last texts as state, with a timer at the end of its time."""

    def __init__(self, keep: int, ttl_us: int) -> None:
        self.keep, self.ttl_us = keep, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "began long, n long")
        self.texts = handle.getListState("texts", "text string")

    def forget(self) -> None:
        self.about.clear()
        self.texts.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """``rows`` of one session in one micro-batch; the size of micro-batches bounds them."""
        began, n = self.about.get() if self.about.exists() else (None, 0)
        texts = [t[0] for t in self.texts.get()] if began is not None else []
        before, made = began, []
        turns = pd.concat(rows).sort_values(["us", "seq", "hash"])
        for us, text, clears in zip(turns["us"], turns["text"], turns["clears"]):
            over = began is not None and us - began > self.ttl_us
            if began is not None and (clears or over):
                made.append((began, n, texts))
                began, n, texts = None, 0, []
            if not clears:
                began, n, texts = us if began is None else began, n + 1, [*texts, text][-self.keep :]
        if before is not None and before != began:
            self.handle.deleteTimer(self._end(before))
        if began is None:
            self.forget()
        else:
            made.append((began, n, texts))
            self.about.update((int(began), int(n)))
            self.texts.put([(t,) for t in texts])
            if before != began:
                self.handle.registerTimer(self._end(began))
        if made:
            yield pd.DataFrame({"session_id": [key[0]] * len(made), "began": pd.to_datetime([m[0] for m in made], unit="us"), "n": [m[1] for m in made], "history": ["\n".join(m[2]) for m in made]})

    def _end(self, began: int) -> int:
        """The first whole millisecond after the session's time."""
        return (int(began) + self.ttl_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists() and self._end(self.about.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.forget()
        return iter(())

    def close(self) -> None:
        pass


def remember(stream: DataFrame, keep: int = KEEP, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same of a stream, in update mode: the last row given for a (session_id, began) is that of ``session_memory``.

    Rows that come ``late`` or less behind may be out of order between sessions; within a session they must come in order of
    micro-batches. State is dropped by timers in event time. The session's state store must be RocksDB's.
    """
    turns = turns_of(stream.withWatermark("at", late))
    return turns.groupBy("session_id").transformWithStateInPandas(Memory(keep, ttl_seconds * 1_000_000), MEMORY, "update", "eventTime")
