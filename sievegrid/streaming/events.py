"""Event-time windows, sessions and an index that grows with a stream (extensions; no batch query needs them)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievegrid.operators import bm25


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows; rows later than the watermark are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(span, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def conversation_memory(turns: DataFrame, keep: int = 20, ttl_ms: int = 3_600_000) -> DataFrame:
    """(session_id, n, history): the last ``keep`` texts of each session, forgotten ``ttl_ms`` after its first one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        texts, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        until = until or state.getCurrentProcessingTimeMs() + ttl_ms
        for batch in batches:
            texts = (texts + batch.sort_values("turn")["text"].tolist())[-keep:]
        state.update((texts, until))
        state.setTimeoutDuration(max(1, until - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(texts)], "history": ["\n".join(texts)]})

    rows = turns.select("session_id", "turn", "text")
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id long, n long, history string", "texts array<string>, until long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def grow_index(children: DataFrame, path: str, checkpoint: str):
    """Appends the postings and sizes of each micro-batch of new children to an index's tables.

    A batch has its own folder, replaced if the batch is run again, so a restart adds nothing twice. Term weights
    depend on all documents and are derived from the tables when they are read.
    """

    def add(batch: DataFrame, number: int) -> None:
        made = bm25.build(batch)
        made.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        made.sizes.write.mode("overwrite").parquet(f"{path}/sizes/batch={number}")

    return children.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown_index(spark, path: str) -> bm25.Index:
    """The index of everything that ``grow_index`` has added so far."""
    postings, sizes = (spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("postings", "sizes"))
    sizes = sizes.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    seen = postings.groupBy("term").agg(F.count("*").alias("df"))
    return bm25.Index(postings, bm25.rated(seen, sizes.select("n").scalar()), sizes)
