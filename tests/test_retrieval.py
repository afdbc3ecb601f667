"""Fusion, pinning, keyword scoping, ranking, context and confidence on literal cases."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

import pytest
from pyspark.sql import functions as F

from sievegrid.functions.text import REPEALED, UNKNOWN
from sievegrid.operators import bm25, containment, context, dedup, dense, evaluation, fusion, keyword, mining, rerank

CHANNEL = "query_id long, child_id string, score double, ord int"


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), CHANNEL)


def test_plain_fusion(spark):
    a = hits(spark, (1, "x", 9.0, 1), (1, "y", 1.0, 2))
    b = hits(spark, (1, "x", 0.5, 1))
    out = {r.child_id: r for r in fusion.fuse({"bm25": a, "dense": b}, {"bm25": 0.5, "dense": 0.5}, alpha=0.0).collect()}
    assert out["x"].score == pytest.approx(0.5 / 61 + 0.5 / 61, abs=1e-6)
    assert out["x"].ranks == {"bm25": 1, "dense": 1} and out["x"].ord == 1 and out["y"].ord == 2


def test_single_channel_caps(spark):
    one = hits(spark, (1, "x", 3.0, 1))
    none = hits(spark).where("false")
    for name, cap in (("keyword", 0.0623), ("dense", 0.1557), ("bm25", 0.0934)):
        channels = {c: one if c == name else none for c in fusion.WEIGHTS}
        assert fusion.fuse(channels).first().score == pytest.approx(cap, abs=1e-4)


def test_score_gap_grows_with_alpha(spark):
    a = hits(spark, (1, "x", 40.0, 1), (1, "y", 1.0, 2))

    def gap(alpha):
        x, y = (r.score for r in fusion.fuse({"bm25": a}, {"bm25": 1.0}, alpha=alpha).orderBy("ord").collect())
        return x - y

    assert gap(0.9) > gap(0.0)


def test_first_per_parent(spark):
    rows = spark.createDataFrame([(1, "c1", "p1", 1), (1, "c2", "p1", 2), (1, "c3", "p2", 3), (1, "c4", "", 4), (1, "c5", None, 5)], "query_id long, child_id string, parent_id string, ord int")
    out = fusion.first_per_parent(rows).orderBy("ord").collect()
    assert [(r.child_id, r.ord) for r in out] == [("c1", 1), ("c3", 2), ("c4", 3), ("c5", 4)]


def test_pin(spark):
    final = hits(spark, *((1, f"f{i}", 1.0 / i, i) for i in range(1, 6)))
    pool = final.unionByName(hits(spark, (1, "e1", 0.01, 6), (1, "e2", 0.01, 7), (1, "e3", 0.01, 8)))

    def ids(*exact):
        frame = spark.createDataFrame([(1, e, i) for i, e in enumerate(exact)] or [], "query_id long, child_id string, ord int")
        return [r.child_id for r in fusion.pin(final, pool, frame, 5).orderBy("ord").collect()]

    assert ids("e1") == ["e1", "f1", "f2", "f3", "f4"]
    assert ids("e1", "e2", "e3") == ["e1", "e2", "f1", "f2", "f3"]
    assert ids("f3") == ids() == ids("unknown") == ["f1", "f2", "f3", "f4", "f5"]


CHILDREN = [
    ("c1", "d1", "甲交易所股票期权交易规则", "第十二条", "甲〔2020〕1号", UNKNOWN),
    ("c2", "d2", "乙交易所股票期权交易规则", "第十二条", None, UNKNOWN),
    ("c3", "d3", "丙交易所风险管理办法", "第十二条", None, REPEALED),
    ("c4", "d1", "甲交易所股票期权交易规则", "第三条", "甲〔2020〕1号", None),
]


@pytest.mark.parametrize(
    ("question", "found"),
    [
        ("《甲交易所股票期权交易规则》第十二条", {("c1", True)}),
        ("第十二条怎么说", {("c1", False), ("c2", False)}),
        ("《乙交易所股票期权交易规则》第三条", {("c4", False)}),
        ("《股票期权交易规则》第十二条", {("c1", True), ("c2", True)}),
        ("什么也没有", set()),
    ],
)
def test_keyword_scoping(spark, question, found):
    children = spark.createDataFrame(CHILDREN, "child_id string, doc_id string, doc_title string, clause_id string, doc_no string, effective_status string")
    queries = spark.createDataFrame([(1, question)], "query_id long, text string")
    out = keyword.keyword_hits(queries, children).collect()
    assert {(r.child_id, r.exact) for r in out} == found
    assert sorted(r.ord for r in out) == list(range(1, len(out) + 1))


def test_null_status_stays(spark):
    rows = spark.createDataFrame([(1, REPEALED), (2, UNKNOWN), (3, None)], "id long, effective_status string")
    assert {r.id for r in keyword.not_repealed(rows).collect()} == {2, 3}


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("a", "cat dog"), ("b", "dog"), ("c", ""), ("d", None), ("e", "bird")], "child_id string, text string")
    queries = spark.createDataFrame([(1, "cat cat"), (2, ""), (3, "unseen")], "query_id long, text string")
    out = bm25.search(bm25.build(docs), queries).collect()
    assert [(r.query_id, r.child_id) for r in out] == [(1, "a")]


def test_index_tables_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", "cat dog"), ("b", "dog"), ("e", "bird")], "child_id string, text string")
    queries = spark.createDataFrame([(1, "cat bird")], "query_id long, text string")
    index = bm25.build(docs)
    index.save(str(tmp_path))
    assert bm25.search(bm25.Index.load(spark, str(tmp_path)), queries).orderBy("ord").collect() == bm25.search(index, queries).orderBy("ord").collect()


def test_knn_skips_unusable_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0, 0.0])], "child_id long, embedding array<double>")
    out = dense.knn(rows.withColumnRenamed("child_id", "query_id"), rows, 5, skip_same=True).collect()
    assert {(r.query_id, r.child_id) for r in out} == {(1, 2), (2, 1)}


def test_rerank_keeps_merged_ranks(spark):
    rows = spark.createDataFrame([(1, f"c{i}", "q", str(s), 1.0 / i, i) for i, s in ((1, 0.1), (2, 0.2), (3, 0.3), (4, 9.9))], "query_id long, child_id string, query string, text string, score double, ord int")
    out = rerank.rerank(rows, lambda q, t: t.cast("double"), 4).orderBy("ord").collect()
    assert [r.fused_rank for r in out] == [4, 3, 2, 1]
    assert rerank.rerank(rows, lambda q, t: t.cast("double"), 0).count() == 4


@pytest.mark.parametrize(
    ("scores", "level", "ambiguous", "margin"),
    [((3.0, -2.0), "high", False, 5.0), ((3.0, 2.95), "high", True, 0.05), ((6.685, 6.157), "high", True, 0.528), ((6.685, 4.0), "high", False, 2.685), ((-1.5, -3.0), "low", False, 1.5), ((0.5,), "medium", False, None), ((), "low", False, None)],
)
def test_confidence(spark, scores, level, ambiguous, margin):
    rows = spark.createDataFrame([(1, i + 1, s, REPEALED if i == 1 else UNKNOWN) for i, s in enumerate(scores)], "query_id long, ord int, score double, effective_status string")
    out = context.confidence(rows, spark.createDataFrame([(1,)], "query_id long")).first()
    assert (out.level, out.ambiguous, out.margin) == (level, ambiguous, margin)
    assert out.stale == (len(scores) > 1)
    if scores:
        assert context.confidence(rows, spark.createDataFrame([(1,)], "query_id long"), reranked=False).first().level == "unknown"


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, 1, "t", "a" * 10), (1, 2, "", "b" * 10), (1, 3, "t", "c" * 100)], "query_id long, ord int, title string, text string")
    out = context.contexts(context.blocks(rows, title="title"), budget=50).first()
    assert out.context == "[1] · t\n" + "a" * 10 + context.SEPARATOR + "[2]\n" + "b" * 10
    assert out.n_blocks == 2


def test_metrics_count_misses(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id long, rank int")
    out = evaluation.metrics(ranks).first()
    assert (out.n, out.recall_1, out.recall_5, out.mrr) == (3, 0.333333, 0.666667, pytest.approx((1 + 0.25) / 3, abs=1e-6))


def test_greedy_keeps_order(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {r.id for r in dedup.greedy_kept(pairs, rows).collect()} == {1, 3, 5}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert {tuple(r) for r in dedup.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r.id for r in dedup.to_add(new, old, ["id"]).collect()] == [3]
    assert [r.id for r in dedup.to_remove(new, old, ["id"]).collect()] == [1]


@pytest.mark.parametrize("size", [0, 1, 31, 32, 33, 500, 5000])
def test_containment_matches_contains(spark, size):
    """Whatever a question's length, and where it stands in a text, all its holders are found."""
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice("ab c第é\n") for _ in range(n))
    asked = [(i, text(size)) for i in range(20)] + [(90, None)]
    held = [(i, text(rng.randrange(60)) + asked[i % 20][1] + text(rng.randrange(60))) for i in range(60)] + [(60, ""), (61, None), (62, text(3000))]
    held += [(0, held[0][1])]
    out = containment.containing(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(held, "child_id long, text string"))
    wanted = sorted((q, c) for q, a in asked for c, h in held if a is not None and h is not None and a in h)
    assert sorted(map(tuple, out.collect())) == wanted


@pytest.mark.parametrize("window, run", containment.LEVELS)
def test_marks_of_long_texts_are_those_of_their_parts(monkeypatch, window, run):
    text = "".join(random.Random(3).choices("abcdef ", k=3000)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    whole = containment.marks(data, window, run)
    for start in range(0, 2900, 113):  # any stretch of a run's length has a mark, and the text has it too
        part = containment.marks(data[start : start + window + run - 1], window, run)
        assert len(part) == 1 and np.isin(part, whole).all()
    monkeypatch.setattr(containment, "_PIECE", 100)
    assert containment.marks(data, window, run).tolist() == whole.tolist()


def test_leaks_ignore_blanks(spark):
    passage = "The holder may exercise the option on any trading day before it expires, 行权 included."
    asked = spark.createDataFrame([(1, passage), (2, passage + " never"), (3, " "), (4, None)], "query_id long, text string")
    corpus = spark.createDataFrame([("x" + passage.replace(" ", "\n  ") + "y",)] * 3 + [(None,)], "text string")
    assert [x.query_id for x in mining.leaks(asked, corpus).collect()] == [1]


def test_marks_take_little_memory():
    """A batch of many texts is marked some at a time, and marks stay arrays."""
    text = "".join(random.Random(1).choices("abcdefghijklmnop ", k=20_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([f"{i} {text}" for i in range(500)])], names=["id", "text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in containment.mark_batches(iter([batch]), [2]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500_000
    assert peak < 64 << 20


def test_documents_are_scored_where_they_lie(spark):
    """With few question terms no row for each question and document moves: the cut of each task comes before the exchange."""
    asked = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "query_id long, text string")
    kids = spark.createDataFrame([(i, f"{'red' if i % 2 else 'blue'} fox {i}") for i in range(40)], "child_id long, text string")
    hits = bm25.search(bm25.build(kids), asked, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, child_id", plan)
    few, bm25.FEW = bm25.FEW, 0
    joined = bm25.search(bm25.build(kids), asked, 3).collect()
    bm25.FEW = few
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, joined))


def test_clauses_everywhere_take_short_lists(spark):
    """Many questions on one clause that many children hold give the first k each, without a row for each pair."""
    kids = spark.range(3000).select(F.col("id").alias("child_id"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("doc_id"), F.concat(F.lit("交易规则"), (F.col("id") % 3).cast("string")).alias("doc_title"), F.lit("第一条").alias("clause_id"), F.lit("上证发〔2020〕1号").alias("doc_no"), F.when(F.col("id") < 100, REPEALED).alias("effective_status"))
    asked = spark.range(3000).select(F.col("id").alias("query_id"), F.concat(F.when(F.col("id") % 2 == 0, "《交易规则1》").otherwise(""), F.lit("第一条，上证发〔2020〕1号")).alias("text"))
    observed = keyword.keyword_hits(asked, kids, None, 4)
    rows = {}
    for r in observed.collect():
        rows.setdefault(r.query_id, []).append((r.ord, r.child_id, r.exact))
    assert len(rows) == 3000
    assert sorted(rows[0]) == [(1, 100, True), (2, 103, True), (3, 106, True), (4, 109, True)]
    assert sorted(rows[1]) == [(1, 100, False), (2, 101, False), (3, 102, False), (4, 103, False)]
    plan = observed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_random_others_are_drawn_in_the_row(spark):
    """A question meets its part as one list: no window sorts a row for each parent met. Never the right parent, never more than there are."""
    parents = spark.range(200).select(F.concat(F.lit("p"), F.col("id")).alias("parent_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("d").alias("doc_title"))
    pairs = spark.range(200).select(F.concat(F.lit("q"), F.col("id")).alias("qa_id"), F.concat(F.lit("p"), F.col("id")).alias("parent_id"))
    out = mining.random_others(pairs, parents, 4)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.qa_id: [x.text for x in r.others] for r in out.collect()}
    assert len(rows) == 200 and all(len(set(v)) == 4 and "t" + k[1:] not in v for k, v in rows.items())
    few = mining.random_others(pairs, parents.where("parent_id IN ('p1', 'p2')"), 4).collect()
    assert {r.qa_id: len(r.others) for r in few} == {f"q{i}": 1 if i in (1, 2) else 2 for i in range(200)}


def test_texts_are_not_split_to_be_filtered(spark):
    """No condition on a text's words is inferred below the explode, which would split each text once more."""
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "child_id long, text string")
    plan = bm25.build(docs).postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_no_text_moves_to_be_scored(spark):
    """Texts and postings stay where they are; the join of postings gives the same, with ties, nulls, texts without words and ids that are strings."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("red blue fox dog cat".split()) for _ in range(rng.randrange(7))) for _ in range(300)] + [None, "", "--", "fox"]
    kids = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts)], "child_id string, text string").repartition(5)
    asked = spark.createDataFrame([(1, "red fox"), (2, "Fox, fox"), (3, "red fox"), (4, None), (5, "owl"), (6, "?")], "query_id long, text string")
    hits = bm25.search(bm25.build(kids), asked, 7)
    assert "hashpartitioning(child_id" not in hits._jdf.queryExecution().executedPlan().toString()
    index = bm25.build(kids)
    index.lists = None
    joined = bm25.search(index, asked, 7)
    got = sorted(map(tuple, hits.collect()))
    assert len(got) == 21 and got == sorted(map(tuple, joined.select(hits.columns).collect()))
    assert bm25.build(kids).sizes.first() == (304, sum(max(1, len((x or "").replace("-", "").split())) for x in texts) / 304)
    named = bm25.search(bm25.build(kids), asked.select(F.struct("query_id").alias("query_id"), "text"), 7)
    assert got == sorted((r.query_id.query_id, r.child_id, r.score, r.ord) for r in named.collect())
    nothing = bm25.search(bm25.build(kids.limit(0)), asked, 7)
    assert nothing.columns == hits.columns and nothing.count() == 0
