"""The inverted file: recall against exact search, the exact setting, pruning, storing and loading, and defined edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.operators import ann, dense

VECTORS = "child_id long, embedding array<double>, cell string, vec int"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), "c", 1) for i, v in enumerate(vectors)], VECTORS)


def lists(out):
    found = {}
    for r in out.collect():
        found.setdefault(r.query_id, []).append((r.ord, r.child_id, r.score))
    return {q: sorted(x) for q, x in found.items()}


def grouped(rng, n, dim=32, groups=60):
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["groups", "noise", "hot"])
def test_recall_and_pruning(spark, tmp_path, kind):
    """Of 6,000 rows the index finds at least 0.95 of the exact lists' rows; in grouped vectors it reads few cells for it."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(6000, 32)) if kind == "noise" else grouped(rng, 6000)
    if kind == "hot":  # half of the rows in one cell
        vectors[:3000] = vectors[0] + 0.05 * rng.normal(size=(3000, 32))
    rows = frame(spark, vectors)
    asked = rows.where("child_id % 40 = 0").withColumnRenamed("child_id", "query_id")
    index = ann.build(rows, str(tmp_path / "index"))
    got, want = lists(ann.search(index, asked, 10, skip_same=True)), lists(dense.knn(asked, rows, 10, skip_same=True))
    hit = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.95 and all(len(x) == 10 for x in got.values())
    pairs = ann.candidates(index, dense.usable(asked, "query_id", "embedding"), 10, True)
    if kind == "groups":
        assert pairs.count() < 0.15 * 150 * 6000  # verified of all pairs
        one = dense.usable(asked.limit(1), "query_id", "embedding")
        plan = ann.candidates(index, one, 10)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
        assert "vec" not in plan.split("PartitionFilters: [")[-1].split("ReadSchema: struct<")[1].split(">")[0]  # codes alone are read first
        visited = ann._probed(one, index.model).select("cell").distinct().count()
        assert visited < len(index.model.cells) / 2


def test_exact_setting_equals_exact_search(spark, tmp_path):
    """Small whole components, so that many distances tie."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (900, 7)).astype(float)
    rows = frame(spark, vectors)
    odd = spark.createDataFrame([(2000, None, "c", 1), (2001, [], "c", 1), (2002, [0.0] * 7, "c", 1), (2003, [1.0, float("nan")] + [0.0] * 5, "c", 1), (2004, [1.0, None] + [0.0] * 5, "c", 1), (2005, [float("inf")] + [0.0] * 6, "c", 1), (None, [1.0] * 7, "c", 1), (2006, [1.0] * 3, "c", 1)], VECTORS)
    asked = rows.unionByName(odd).withColumnRenamed("child_id", "query_id")
    index = ann.build(rows.unionByName(odd), str(tmp_path / "index"), recall=1.0, cells=13)
    sound = rows.where(F.exists("embedding", lambda x: x != 0))
    for same in (False, True):
        assert lists(ann.search(index, asked, 5, skip_same=same)) == lists(dense.knn(sound.withColumnRenamed("child_id", "query_id"), sound, 5, skip_same=same))


def test_stored_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = frame(spark, grouped(rng, 1000))
    path = str(tmp_path / "index")
    asked = rows.limit(20).withColumnRenamed("child_id", "query_id")
    built = lists(ann.search(ann.build(rows, path), asked, 5))
    index = ann.Index.load(spark, path)
    assert lists(ann.search(index, asked, 5)) == built
    assert index.entries.count() == 1000 and {c.name for c in index.entries.schema} == {"cell", "id", "codes", "error", "vec"}
    assert len(index.model.cells) == len([p for p in (tmp_path / "index" / "entries").iterdir() if p.name.startswith("cell=")])


def test_codes_bound_distances():
    """What a code says is off by its error at most, so nothing that is ruled out could be among the best."""
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(500, 10))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    model = ann.Model(ann._fitted(unit, 7, rng), [], 1.0)
    rest = unit - model.cells[ann._square(unit, model.cells).argmin(axis=1)]
    model.books = [ann._fitted(part, 16, rng) for part in model.stretches(rest)]
    cell, codes, error = model.coded(unit)
    for query in unit[:20]:
        for c in range(7):
            own = cell == c
            real = np.linalg.norm(unit[own] - query, axis=1)
            assert (np.abs(model.distances(query, c, codes[own]) - real) <= error[own] + 1e-7).all()


def test_empty_and_few(spark, tmp_path):
    none = ann.build(frame(spark, np.zeros((0, 3))), str(tmp_path / "none"))
    few = frame(spark, np.array([[1.0, 0.0], [0.0, 1.0]]))
    asked = few.withColumnRenamed("child_id", "query_id")
    assert ann.search(none, asked).count() == 0
    index = ann.build(few, str(tmp_path / "few"))
    assert lists(ann.search(index, asked, 5, skip_same=True)) in ({0: [(1, 1, 0.0)], 1: [(1, 0, 0.0)]}, {})
    assert lists(ann.search(ann.build(few, str(tmp_path / "all"), recall=1.0), asked, 5)) == {0: [(1, 0, 1.0), (2, 1, 0.0)], 1: [(1, 1, 1.0), (2, 0, 0.0)]}
    twice = ann.build(few.union(few), str(tmp_path / "twice"), recall=1.0)
    assert [(o, i) for o, i, _ in lists(ann.search(twice, asked.limit(1), 5))[0]] == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert ann.search(index, asked.where("false")).count() == 0


def test_vectors_move_in_tiles(spark, tmp_path):
    """No plan joins a row for each candidate with both vectors, and small tiles and shelves give the same lists."""
    rng = np.random.default_rng(5)
    rows = frame(spark, rng.normal(size=(400, 8)))
    asked = rows.withColumnRenamed("child_id", "query_id")
    index = ann.build(rows, str(tmp_path / "index"), recall=1.0, cells=9)
    found = ann.search(index, asked, 5, skip_same=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    want, kept = lists(dense.knn(asked, rows, 5, skip_same=True)), (ann.SHELF_ROWS, ann.SHELF_QUERIES, ann.MOST_HELD)
    assert lists(found) == want
    ann.SHELF_ROWS, ann.SHELF_QUERIES, ann.MOST_HELD = 20, 100, 300
    small = lists(ann.search(index, asked, 5, skip_same=True))
    ann.SHELF_ROWS, ann.SHELF_QUERIES, ann.MOST_HELD = kept
    assert small == want
