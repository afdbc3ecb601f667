"""Exact search: what single precision rules out is never among the best."""

from __future__ import annotations

import numpy as np

from sievegrid.operators import dense


def slow(asked, units, ids, q, k):
    score = np.round(asked @ units.T, dense.DIGITS)
    return [[(int(j), float(score[i, j])) for j in np.lexsort((np.arange(len(ids)), -score[i])) if q is None or ids[j] != q[i]][:k] for i in range(len(asked))]


def test_screened_rows_are_never_among_the_best(monkeypatch):
    """Copies, rows that differ in the seventh digit, repeated ids and fewer rows than asked for."""
    monkeypatch.setattr(dense, "PAIRS", 100)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(600, 16))
    base[100:300] = base[0] + rng.normal(size=(200, 16)) * 1e-6
    base[300:400] = base[1]
    for n, k in ((600, 5), (600, 60), (7, 10)):
        units = base[:n] / np.linalg.norm(base[:n], axis=1)[:, None]
        ids = np.sort(np.append(np.arange(n - 1), 3))
        for own in (True, False):
            q = ids[: min(n, 40)]
            same = (np.searchsorted(ids, q), np.searchsorted(ids, q, "right")) if own else None
            query, row, score = dense._best(units[: len(q)], units, units.astype(np.float32), same, k)
            got = [[(int(r), float(s)) for r, s in zip(row[query == i], score[query == i])] for i in range(len(q))]
            want = slow(units[: len(q)], units, ids, q if own else None, k)
            assert [[r for r, _ in x] for x in got] == [[r for r, _ in x] for x in want]
            assert np.allclose([s for x in got for _, s in x], [s for x in want for _, s in x], atol=1e-9)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)] + [(200 + i, [1.0, 2.0, 0.0, 0.0]) for i in range(9)], "child_id long, embedding array<float>")
    asked = rows.withColumnRenamed("child_id", "query_id")
    want = sorted(map(tuple, dense.knn(asked, rows, 4, skip_same=True).collect()))
    monkeypatch.setattr(dense, "BLOCK", 10)
    monkeypatch.setattr(dense, "LARGE", 25)
    assert sorted(map(tuple, dense.knn(asked, rows, 4, skip_same=True).collect())) == want
