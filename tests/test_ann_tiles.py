"""One task of a search in the inverted file: its lists against brute force, how much it verifies, and what moves to find the cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sievegrid.operators import ann, dense


def tile(kind, rng, n=2000, dim=16, cells=12):
    """A model, its rows and queries that look at some of the cells, one of them at none here."""
    vectors = rng.normal(size=(n, dim))
    if kind == "groups":
        vectors = rng.normal(size=(100, dim))[rng.integers(0, 100, n)] + 0.02 * rng.normal(size=(n, dim))
    elif kind == "ties":
        vectors = rng.integers(-1, 2, (n, dim)).astype(float) + np.eye(dim)[0] * 2
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    model = ann.Model(ann._fitted(unit, cells, rng), [], 1.0)
    model.books = [ann._fitted(x, ann.CODES, rng) for x in model.stretches(unit - model.cells[ann._square(unit, model.cells).argmin(axis=1)])]
    cell, codes, error = model.coded(unit)
    order = rng.permutation(n)
    right = pa.table({"cell": pa.array(cell[order], pa.int32()), "id": order, "codes": pa.array([c.tobytes() for c in codes[order]], pa.binary()), "error": error[order], "vec": pa.array(vectors[order].tolist())})
    asked = np.arange(0, n, 4)
    look = rng.random((len(asked), cells)) < 0.6
    look[5] = False
    lists = [[*np.flatnonzero(x).tolist(), cells + 3] for x in look]  # the last lies on this shelf but has no rows here
    left = pa.table({"query_id": asked, "vec": pa.array(vectors[asked].tolist()), "cells": pa.array(lists, pa.list_(pa.int32()))})
    model.cells = np.vstack([model.cells, np.zeros((4, dim))])
    return model, left, right, unit, asked, look[:, cell]


def brute(unit, asked, look, k, skip_same):
    score = np.round(np.einsum("id,jd->ij", unit[asked], unit), dense.DIGITS)
    hidden = ~look | (skip_same & (asked[:, None] == np.arange(len(unit))))
    return {int(q): [int(j) for j in np.lexsort((np.arange(len(unit)), -s)) if not h[j]][:k] for q, s, h in zip(asked, score, hidden) if not h.all()}


@pytest.mark.parametrize("kind", ["noise", "groups", "ties"])
@pytest.mark.parametrize("held", [1 << 21, 30_000])
@pytest.mark.parametrize("skip_same", [True, False])
def test_lists_equal_brute_force(kind, held, skip_same, monkeypatch):
    monkeypatch.setattr(ann, "MOST_HELD", held)
    model, left, right, unit, asked, look = tile(kind, np.random.default_rng(8))
    got: dict[int, list] = {}
    for q, i, s in zip(*(x.tolist() for x in ann._searched(model, left, right, 5, skip_same))):
        got.setdefault(q, []).append((-s, i))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == brute(unit, asked, look, 5, skip_same)


@pytest.mark.parametrize("kind", ["noise", "groups"])
def test_few_pairs_are_verified(kind, monkeypatch):
    """Where codes rule out little, as on noise, it isn't every pair that is worked out in double precision."""
    sizes, real = [], np.round
    monkeypatch.setattr(np, "round", lambda x, *a: sizes.append(np.size(x)) or real(x, *a))
    model, left, right, _, asked, look = tile(kind, np.random.default_rng(9))
    ann._searched(model, left, right, 5, True)
    assert 0 < sum(sizes) < 0.03 * look.sum()


def test_codes_screen_while_they_pay(monkeypatch):
    used, real = [], dense._left
    monkeypatch.setattr(dense, "_left", lambda *a: used.append(a[4] is not None) or real(*a))
    monkeypatch.setattr(ann, "MOST_HELD", 100_000)
    for kind, want in (("groups", lambda x: all(x)), ("noise", lambda x: x[0] and not any(x[1:]))):
        used.clear()
        ann._searched(*tile(kind, np.random.default_rng(10))[:3], 5, True)
        assert len(used) > 5 and want(used)


def test_cells_are_found_without_a_row_for_each_query_and_cell(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "child_id long, embedding array<double>")
    index = ann.build(rows, str(tmp_path / "index"), recall=1.0, cells=5)
    asked = rows.withColumnRenamed("child_id", "query_id")
    want = sorted(map(tuple, dense.knn(asked, rows, 4, skip_same=True).collect()))
    monkeypatch.setattr(ann, "_probed", None)
    assert sorted(map(tuple, ann.search(index, asked, 4, skip_same=True).collect())) == want
