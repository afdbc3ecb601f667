"""The inverted multi-index on a large group of near copies, where every pair is a link."""

from __future__ import annotations

import tracemalloc

import numpy as np

from sievegrid.llm import multiindex


def test_links_of_a_large_group_need_no_row_of_distances_each():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(3000, 32))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    grid = multiindex.Grid(noise, 200, 0.95, 0.99)
    unit = noise[0] + 0.005 * rng.normal(size=(700, 32))
    unit = np.vstack([unit / np.linalg.norm(unit, axis=1)[:, None], noise[1:300]])
    ids, sizes, weights = np.arange(len(unit)) + 10, np.full(len(unit), 32), np.ones(len(unit), np.int64)
    weights[699] = 3
    tracemalloc.start()
    counts, roots = multiindex.tile_links(grid, (ids, ids), (unit, unit), (sizes, sizes), (weights, weights), 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    assert close.sum() == 700 * 699 and roots == {i: 10 for i in range(11, 710)}
    back = grid.excess(tuple(np.repeat(x, len(unit), axis=0) for x in grid.distances(unit)), np.tile(grid.home(unit), len(unit))).reshape(close.shape) > grid.margin  # of listed and sought
    want = close @ weights + (close & back) @ weights
    assert counts == {int(i): int(n) for i, n in zip(ids, want) if n}
    assert peak < 200e6  # a row of 200 distances for each pair and codebook would be 1.5 GB
