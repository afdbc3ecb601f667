"""The manifest log: restarts, repeated batches, unfinished compactions, and the same answer before and after compaction."""

from __future__ import annotations

import pytest

from sievegrid.sources.manifest_log import ManifestLog

SCHEMA = "id string, status string, local_path string, at long, batch string"


def _rows(spark, rows):
    """The last column clashes with the log's own folders by name."""
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def _good(log):
    return sorted((r.id, r.local_path, r.at) for r in log.last_good().collect())


ONE = [("a", "ok", "a1", 1), ("a", "ok", "a2", 2), ("b", "ok", "b1", 1), ("c", "failed", "c1", 1), (None, "ok", "n", 1)]
TWO = [("a", "failed", "a3", 3), ("b", "skipped", "b2", 1), ("b", "skipped", "b3", 1), ("d", "ok", "", 1), ("e", "ok", None, 1), ("f", None, "f", 1)]
WANT = [("a", "a2", 2), ("b", "b3", 1)]


def test_compaction_changes_no_answer(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "log"))
    with pytest.raises(ValueError):
        log.last_good()
    assert log.compact() == -1
    log.append(_rows(spark, ONE), 0)
    log.append(_rows(spark, TWO), 1)
    assert _good(log) == WANT
    assert log.compact() == 1 and _good(log) == WANT
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["base=1"]
    log.append(_rows(spark, [("z", "ok", "z", 9)]), 1)  # held by the base already
    assert _good(log) == WANT
    log.append(_rows(spark, [("c", "ok", "c2", 0)]), 2)
    log.append(_rows(spark, []), 3)
    assert _good(log) == [*WANT, ("c", "c2", 0)]
    assert log.compact() == 3 and _good(log) == [*WANT, ("c", "c2", 0)]


def test_unfinished_folders_are_not_read(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "log"))
    log.append(_rows(spark, ONE), 0)
    for name in ("base=0", "batch=1"):
        _rows(spark, [("q", "ok", "q", 1)]).write.parquet(str(tmp_path / "log" / name))
        (tmp_path / "log" / name / "_SUCCESS").unlink()
    assert _good(log) == [("a", "a2", 2), ("b", "b1", 1)]


def test_restarted_stream_adds_nothing_twice(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "log"))
    _rows(spark, ONE).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*"))
    log.append_stream(stream, str(tmp_path / "c")).awaitTermination(120)
    _rows(spark, TWO).coalesce(1).write.parquet(str(tmp_path / "in/2"))

    class Dies(ManifestLog):
        def append(self, rows, number):
            super().append(rows, number)
            raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        Dies(spark, log.path).append_stream(stream, str(tmp_path / "c")).awaitTermination(120)
    log.append_stream(stream, str(tmp_path / "c")).awaitTermination(120)
    assert _good(log) == WANT
    assert spark.read.parquet(log.path).count() == len(ONE) + len(TWO)
