"""Session memory: literal cases, and a stream of three micro-batches against the batch plan."""

from __future__ import annotations

import time

import pytest

from sievegrid.streaming import memory

SCHEMA = "session_id long, at timestamp, seq long, text string, clears boolean, n string"


def _rows(spark, rows):
    """Minutes after midnight as times; ``n`` is a column whose name clashes with the result's."""
    made = spark.createDataFrame([(s, None if m is None else m * 60, q, t, c, "x") for s, m, q, t, c in rows], "session_id long, m long, seq long, text string, clears boolean, n string")
    return made.selectExpr("session_id", "timestamp_seconds(1700000000 + m) AS at", "seq", "text", "clears", "n")


def _found(frame):
    return sorted((r.session_id, int(r.began.timestamp() - 1700000000) // 60, r.n, r.history) for r in frame.collect())


TURNS = [(1, 0, 0, "a", False), (1, 10, 1, "b", None), (1, 60, 2, "c", False), (1, 61, 3, "d", False), (2, 5, 0, "x", False), (2, 6, 1, None, True), (2, 7, 2, None, False), (None, 1, 0, "lost", False), (3, None, 0, "lost", False), (4, 1, 0, "", True)]


def test_session_memory(spark):
    """An hour counts from the beginning, clearing forgets, null texts are empty, null sessions and times take no part."""
    assert _found(memory.session_memory(_rows(spark, TURNS), keep=2)) == [(1, 0, 3, "b\nc"), (1, 61, 1, "d"), (2, 5, 1, "x"), (2, 7, 1, "")]
    assert memory.session_memory(_rows(spark, TURNS).where("false")).count() == 0
    repeated = [(1, 0, 0, "a", False)] * 3
    assert _found(memory.session_memory(_rows(spark, repeated))) == [(1, 0, 3, "a\na\na")]


def test_busy_session_across_batches(spark):
    """A session of more rows than an Arrow batch holds keeps its count and beginning."""
    rows = spark.sql("SELECT 1L AS session_id, timestamp_millis(id) AS at, id AS seq, concat('t', id) AS text, false AS clears FROM range(30000)")
    assert [(r.n, r.history) for r in memory.session_memory(rows, keep=2).collect()] == [(30000, "t29998\nt29999")]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_equals_batch(spark, rocksdb, tmp_path):
    turns = [(s, m, m, f"t{s}-{m}", m % 17 == 0) for s in range(5) for m in range(s, 300, 7 + s)]
    rows = _rows(spark, turns)
    parts = [rows.where("seq < 90"), rows.where("seq >= 90 AND seq < 200"), rows.where("seq >= 200")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        time.sleep(1.1)  # files are taken in the order of their times
    given = {}

    def take(batch, number):
        for r in batch.collect():
            given[r.session_id, r.began] = r

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    running = memory.remember(stream, keep=3).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 180  # timers keep such a query busy, so it never says that all is done
    while (running.lastProgress is None or running.lastProgress["batchId"] < 3) and running.exception() is None and time.time() < until:
        time.sleep(0.5)
    failed = running.exception()
    running.stop()
    assert failed is None
    want = {(r.session_id, r.began): (r.n, r.history) for r in memory.session_memory(rows, keep=3).collect()}
    assert {k: (r.n, r.history) for k, r in given.items()} == want
