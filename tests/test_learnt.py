"""The learnt second stage: sums against a plain softmax, edge cases, and held-out questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sievegrid.operators import learnt, rerank
from sievegrid.plans import catalog

POOL = "query_id long, query string, child_id long, text string, score double, ord int"


def _pool(spark, rows):
    return spark.createDataFrame(rows, POOL)


def test_sums_are_those_of_a_softmax():
    """The gradient equals differences of the loss, and the curvature differences of the gradient."""
    draw = np.random.default_rng(3)
    frame = pd.DataFrame({"x": [list(draw.normal(size=(n, learnt.FEATURES))) for n in (2, 5, 9)], "y": [[1.0, 0.0], [0.0, 1.0, 0.0, 1.0, 0.0], [0.0] * 8 + [1.0]]})
    weights = draw.normal(size=learnt.FEATURES)

    def sums(w):
        return next(learnt._sums(iter([frame]), list(w)))["part"].to_numpy()

    here, k = sums(weights), learnt.FEATURES
    for i in range(k):
        step = np.eye(k)[i] * 1e-5
        ahead, behind = sums(weights + step), sums(weights - step)
        assert abs((ahead[0] - behind[0]) / 2e-5 - here[1 + i]) < 1e-6
        assert np.allclose((ahead[1 : 1 + k] - behind[1 : 1 + k]) / 2e-5, here[1 + k :].reshape(k, k)[i], atol=1e-6)


def test_groups_that_teach(spark):
    rows = [(1, "a b", 1, "a b c", 0.5, 1), (1, "a b", 2, None, None, None), (2, "a", 3, "a", 0.5, 1), (3, "a", 4, "a", 0.5, 1), (3, "a", 5, "b", 0.4, 2), (4, None, 6, "x", 0.1, 1), (4, None, 7, "", 0.1, 2)]
    gold = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 7), (4, 7), (5, None)], "query_id long, gold long")
    found = {r.query_id: (list(r.y), len(r.x[0])) for r in learnt.groups(_pool(spark, rows), gold).collect()}
    assert found == {1: ([0.0, 1.0], learnt.FEATURES), 4: ([0.0, 1.0], learnt.FEATURES)}


def test_nothing_to_learn_from(spark):
    pool = _pool(spark, [(1, "a b", 1, "a c", 0.1, 2), (1, "a b", 2, "b a", 0.1, 1)])
    weights, losses = learnt.train(pool, spark.createDataFrame([], "query_id long, gold long"))
    assert weights == learnt.START and losses == []
    first, second = (rerank.rerank(pool, s, 2).orderBy("ord").select("child_id").collect() for s in (rerank.overlap, learnt.scorer(weights)))
    assert first == second


def test_loss_falls(spark):
    """The right answer is always the short text, whatever the overlap says."""
    rows = [(q, "a b", 10 * q + i, "a" if i == 0 else "a b c d e f g h", 0.1, i + 1) for q in range(12) for i in range(3)]
    gold = spark.createDataFrame([(q, 10 * q) for q in range(12)], "query_id long, gold long")
    weights, losses = learnt.train(_pool(spark, rows), gold)
    assert losses[-1] < 0.2 < losses[0]
    best = rerank.rerank(_pool(spark, rows), learnt.scorer(weights), 1)
    assert {r.child_id % 10 for r in best.collect()} == {0}


def test_no_worse_than_overlap_on_held_out_questions(spark):
    """On the given questions both stages are about equal; the README has the figures."""
    found = {r.stage: r for r in catalog.ablation_learnt(spark, "/root/testdata/sf0.01").collect()}
    assert len({r.n for r in found.values()}) == 1
    assert found["learnt"].mrr >= found["overlap"].mrr > found["merged"].mrr


def test_right_documents_are_sought_once(spark, monkeypatch):
    """Training and the ranks of each stage read the right documents that were written; texts are not searched for each anew."""
    seen, found = spark.sparkContext.accumulator(0), catalog._gold

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(catalog, "_gold", lambda spark, sf_dir: found(spark, sf_dir).withColumn("gold", counted("gold")))
    assert catalog.ablation_learnt(spark, "/root/testdata/sf0.001").count() == 3
    assert seen.value == catalog.questions(spark, "/root/testdata/sf0.001").count()
