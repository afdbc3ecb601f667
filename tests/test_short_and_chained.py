"""Short questions meet few texts, and greedy de-duplication takes as many rounds as it has pairs, not as a chain is long."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievegrid.operators import containment, dedup, generation

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.parametrize("size", [1, 2, 4, 6, 8, 10, 12, 14, 20])
def test_few_candidates(spark, size):
    """A hundred questions cut out of the texts: up to 8 bytes only real holders are candidates, beyond that few others."""
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(size)
    ascii_ = [t for t in texts.values() if t.isascii() and len(t) > 100]
    asked = [(i, t[at : at + size]) for i in range(100) for t in [rng.choice(ascii_)] for at in [rng.randrange(len(t) - size)]]
    left, right = spark.createDataFrame(asked, "id long, text string"), docs.toDF("id", "text")
    found = containment.candidates(left, right, [containment._level(size)]).count()
    real = sum(q in t for _, q in asked for t in texts.values())
    assert real <= found <= (real if size <= 8 else real + 0.05 * 100 * len(texts))
    if size == 6:
        assert found < 0.3 * 100 * len(texts)


def test_empty_questions(spark):
    asked = spark.createDataFrame([(1, ""), (2, ""), (3, "b"), (4, None)], "query_id long, text string")
    held = spark.createDataFrame([(7, "abc"), (8, ""), (9, None)], "child_id long, text string")
    out = containment.containing(asked, held)
    assert sorted(map(tuple, out.collect())) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 7)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def slow_greedy(n, pairs):
    earlier, kept = {}, set()
    for a, b in pairs:
        earlier.setdefault(b, []).append(a)
    for i in range(n):
        if not any(a in kept for a in earlier.get(i, [])):
            kept.add(i)
    return kept


def kept(spark, n, pairs, **more):
    rows = spark.range(n)
    frame = spark.createDataFrame(pairs, "a long, b long")
    return {r.id for r in dedup.greedy_kept(frame, rows, **more).collect()}


@pytest.fixture
def cuts(monkeypatch):
    seen = []
    real = dedup._cut
    monkeypatch.setattr(dedup, "_cut", lambda df: seen.append(1) or real(df))
    return seen


def test_a_long_chain_takes_few_rounds(spark, cuts):
    pairs = [(i, i + 1) for i in range(9_999)]
    assert kept(spark, 10_000, pairs) == slow_greedy(10_000, pairs) == set(range(0, 10_000, 2))
    assert len(cuts) <= 6


@pytest.mark.parametrize("task_pairs", [40, 1 << 20])
def test_greedy_matches_a_loop(spark, cuts, task_pairs):
    """Random pairs, a chain and a star, whole or in blocks of a few pairs."""
    rng = random.Random(6)
    n = 300
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(250)} | {(i, i + 1) for i in range(100, 160)} | {(5, i) for i in range(200, 230)}
    assert kept(spark, n, [*pairs, *list(pairs)[:20]], task_pairs=task_pairs) == slow_greedy(n, pairs)


def test_greedy_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert dedup.greedy_kept(none, spark.range(0)).count() == 0
    assert sorted(r.id for r in dedup.greedy_kept(none, spark.range(3)).collect()) == [0, 1, 2]
    assert dedup.greedy_kept(none, spark.range(2).withColumn("x", F.lit(1)).withColumnRenamed("id", "k"), "k").columns == ["k"]


def test_short_texts_are_marked_together(monkeypatch):
    """Many short texts are not marked one by one, and get the marks that they get alone."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c第é") for _ in range(rng.choice([0, 1, 7, 8, 15, 62, 63, 90]))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["id", "text"])
    wanted = [(i, level, m) for i, x in enumerate(texts) for level in (0, 1, 6) for m in containment.marks(np.frombuffer(x.encode(), np.uint8), *containment.LEVELS[level]).view(np.int64).tolist()]
    calls, alone = [], containment.marks
    monkeypatch.setattr(containment, "marks", lambda *x: calls.append(1) or alone(*x))
    for part in (batch, batch.slice(900, 800)):
        got = [r for out in containment.mark_batches(iter([part]), [0, 1, 6]) for r in zip(*(c.to_pylist() for c in out.columns))]
        ids = set(part.column(0).to_pylist())
        assert sorted(got) == sorted(x for x in wanted if x[0] in ids)
    assert len(calls) < 30


def test_a_model_is_asked_once(spark):
    """The search for leaks reads the answers that were written, it makes none."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(question):
        asked.add(1)
        return f"other words: {question}"

    pairs = spark.createDataFrame([(f"q{i}", f"question {i}?") for i in range(5)], "qa_id string, question string")
    corpus = spark.createDataFrame([("it says other words: question 3? there",)], "text string")
    out = generation.reworded(pairs, lambda m: said(F.element_at(m, -1)["content"]), corpus)
    assert sorted(r.qa_id for r in out.collect()) == ["q0_pp", "q1_pp", "q2_pp", "q4_pp"]
    assert asked.value == 5
