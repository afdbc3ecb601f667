"""Nearest neighbours by collisions, delta clustering and fill-in-middle: brute force, round trips and the defined edge cases."""

from __future__ import annotations

import random
import re
import time
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import collisions, fim, lloyd
from tests.llm.test_operators import clashing, documents

VECTORS = "vec_id long, embedding array<double>"
ODD_VECTORS = [(9000, None), (9100, []), (9200, [1.0, float("nan"), 0.0, 0.0]), (9300, [1.0, None, 0.0, 0.0]), (9400, [0.0] * 4), (None, [1.0] * 4), (9500, [float("inf"), 0.0, 0.0, 0.0])]


# --- 11 nearest neighbours by collisions -------------------------------------------------------------------------
def slow_nearest(rows, query, k):
    return sorted((float(np.sqrt(((np.array(v) - np.array(rows[query])) ** 2).sum())), i) for i, v in rows.items() if i != query)[:k]


def recall_of(out, rows, queries, k=10):
    """Share of the k nearest that were found, with the check that each distance is right and each list is in order."""
    hit = 0
    for q in queries:
        found = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, min(k, len(rows) - 1) + 1))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        for r in found:
            assert r.vec_id != q and r.score == pytest.approx(float(np.linalg.norm(np.array(rows[r.vec_id]) - np.array(rows[q]))), rel=1e-12, abs=1e-15)
        limit = slow_nearest(rows, q, k)[-1][0] if found else 0
        hit += sum(r.score <= limit * (1 + 1e-12) for r in found)
    return hit / (len(queries) * min(k, len(rows) - 1))


@pytest.mark.parametrize("kind", ["noise", "groups", "copies", "scales"])
def test_collisions_recall(spark, kind):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4000, 32))
    if kind == "groups":
        vectors = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.05 * vectors
    if kind == "copies":
        vectors[1000:3000] = vectors[0]
    if kind == "scales":
        vectors *= 10.0 ** rng.integers(-120, 120, 4000)[:, None]
    rows = dict(enumerate(vectors.tolist()))
    frame = spark.createDataFrame(list(rows.items()), VECTORS)
    out = collisions.nearest(frame.where("vec_id % 100 = 0"), frame, block_rows=1500).collect()
    assert recall_of(out, rows, range(0, 4000, 100)) >= 0.95


def test_collisions_exact_setting(spark):
    rng = np.random.default_rng(6)
    rows = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(1, 301)}
    rows = {i: v for i, v in rows.items() if any(v)}
    frame = clashing(spark.createDataFrame([*rows.items(), *ODD_VECTORS, (9600, [1.0, 2.0])], VECTORS))
    out = collisions.nearest(frame.where("vec_id % 25 = 0"), frame, recall=1.0, block_rows=64).collect()
    queries = [i for i in rows if i % 25 == 0]
    assert {r.query_id for r in out} == set(queries)  # 9600 has no partner of its length
    for q in queries:
        assert [(r.score, r.vec_id) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == slow_nearest(rows, q, 10)


def test_collisions_work_falls(spark):
    """In groups, a small part of the rows is verified; collisions are asked for by the recall wanted."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(50, 64))[rng.integers(0, 50, 5000)] + 0.1 * rng.normal(size=(5000, 64))
    found = list(collisions.Lines(rows, np.arange(5000)).search(rows[:50], np.arange(50), 10, collisions.collisions_needed(64, 0.97)))
    assert np.mean([n for _, _, n in found]) < 300
    assert collisions.collisions_needed(64, 1.0) == 0 < collisions.collisions_needed(64, 0.999) < collisions.collisions_needed(64, 0.9) < 64


def test_collisions_small_and_repeated(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (100, [3.0, 0.0]), (100, [2.0, 9.0])], VECTORS)
    out = collisions.nearest(few.where("vec_id % 100 = 0"), few).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in out if r.query_id == 0] == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 100, 2.0), (5, 100, pytest.approx(82**0.5))]
    assert [(r.rank, r.vec_id) for r in out if r.query_id == 100] == [(1, 1), (2, 1), (3, 1), (4, 0)]  # from the smaller of its vectors, (2, 9)
    assert collisions.nearest(few.where("false"), few).count() == 0 == collisions.nearest(few, few.where("false")).count()
    assert [f"{f.name} {f.dataType.simpleString()}" for f in collisions.nearest(few, few).schema] == ["query_id bigint", "rank int", "vec_id bigint", "score double"]


def test_collisions_of_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    out = collisions.op11_collisions(spark, "/root/testdata/sf0.01").collect()
    queries = [i for i in rows if i % 100 == 0]
    assert {r.query_id for r in out} == set(queries)
    assert recall_of(out, rows, queries) >= 0.95


# --- 12 delta clustering -----------------------------------------------------------------------------------------
def slow_lloyd(rows, k=8, rounds=10, dim=4, scale=1024, seed=3):
    """Plain Lloyd in Python's whole numbers: every vector against every centroid in every round."""
    whole = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    centres = [v for _, _, v in sorted((i is None, sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in whole)[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in whole]
    for _ in range(rounds):
        own = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(whole, own) if c == n]
            if mine:
                centres[n] = [sum(column) // len(mine) for column in zip(*mine)]
    out = assign()
    total = sum(d for d, _ in out)
    each = [sum(d for d, c in out if c == n) for n in range(len(centres))]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i is None, i or 0), c, d, each[c], total, digests[c]) for (i, _), (d, c) in zip(whole, out))


def lloyd_rows(out):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


@pytest.mark.parametrize("kind", ["noise", "groups", "copies", "few", "ids"])
def test_lloyd_matches_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 4))
    if kind == "groups":
        vectors = rng.normal(size=(6, 4))[rng.integers(0, 6, 400)] + 0.1 * vectors
    if kind == "copies":
        vectors[100:] = vectors[0]
    if kind == "few":
        vectors = vectors[:5]
    ids = list(range(len(vectors)))
    if kind == "ids":  # shared and missing ids
        ids = [None if i % 5 == 0 else i % 7 for i in ids]
    rows = list(zip(ids, vectors.tolist()))
    odd = [(9001, None), (9002, []), (9003, [1.0, float("nan"), 0.0, 0.0]), (9004, [1.0, None, 0.0, 0.0]), (9005, [1.0] * 3), (9006, [1e30, 0.0, 0.0, 0.0])]
    frame = clashing(spark.createDataFrame(rows + odd, VECTORS)).repartition(3)
    assert lloyd_rows(lloyd.cluster(frame, dim=4)) == slow_lloyd(rows)


def test_lloyd_compares_little(spark):
    """Rows whose centroid stayed are only compared with those that moved."""
    rng = np.random.default_rng(9)
    rows, centres = rng.integers(-100, 100, (500, 6)), rng.integers(-100, 100, (5, 6))
    owner, distance = lloyd.reassigned(rows, np.full(500, -1), np.zeros(500, dtype=np.int64), centres, np.arange(5))
    after = centres.copy()
    after[[1, 3]] += rng.integers(-60, 60, (2, 6))
    got = lloyd.reassigned(rows, owner, distance, after, np.array([1, 3]))
    far = ((rows[:, None] - after) ** 2).sum(axis=2)
    assert (got[0] == far.argmin(axis=1)).all() and (got[1] == far.min(axis=1)).all()
    assert (lloyd.reassigned(rows, owner, distance, centres, np.array([], dtype=int))[0] == owner).all()


def test_lloyd_large_numbers(spark):
    rows = [(i, [(-1) ** i * 131071.9, 131071.5 - i, -131071.0, 0.1 * i]) for i in range(20)]
    assert lloyd_rows(lloyd.cluster(spark.createDataFrame(rows, VECTORS), dim=4)) == slow_lloyd(rows)


def test_lloyd_empty_and_plan(spark):
    empty = lloyd.cluster(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and [f"{f.name} {f.dataType.simpleString()}" for f in empty.schema] == ["vec_id bigint", "cluster int", "distance bigint", "cluster_inertia bigint", "inertia bigint", "centroid_sha256 string"]
    plan = lloyd.op12_deltalloyd(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange hashpartitioning" not in plan  # assignments are joined where they lie


# --- 13 fill-in-middle -------------------------------------------------------------------------------------------
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow_fim(text, name):
    units = UNIT.findall(text)
    digest = sha256(f"42:{name}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_matches_brute_force(spark):
    rng = random.Random(4)
    letters = ["a", "B", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "é", "中", "😀", " ", " ", "​", "\x00", "<", "P>", "<S", "é", "."]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(600)]
    texts += [None, "", " ", "\n\n", "x", " x", "x ", "a <P> b", "a<S>", "<M>", "<p> b c d", "word " * 50_000, " " * 200_000, "a" + " " * 200_000 + "b", "y" * 300_000]
    out = fim.fill_in_middle(clashing(documents(spark, *texts)))
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).select("row.doc_id", "row.text", "row.key", *out.columns[1:], "back").collect()
    assert len(out) == len(texts) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        text = texts[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow_fim(text, r.doc_id)
        assert r.back == text and r.text == texts[r.doc_id] and r.key == "y"


def test_fim_stretches(spark):
    """Long texts come out alike however they are cut into stretches; many blanks in a row take no longer than words."""
    rng, split = random.Random(5), fim.splitter()
    for _ in range(200):
        text = "".join(rng.choices("ab \n中", weights=(4, 2, 2, 1, 1), k=rng.randrange(200)))
        want = [m.end() for m in UNIT.finditer(text)]
        for stretch in (1, 2, 7, 50, 1 << 20):
            assert fim.unit_ends(text, split, stretch).tolist() == want
    start = time.perf_counter()
    assert len(fim.unit_ends(" " * 5_000_000, split)) == 1 and len(fim.unit_ends("x" + " " * 5_000_000 + "y", split)) == 2
    assert time.perf_counter() - start < 30


def test_fim_null_ids_and_empty_tables(spark):
    docs = documents(spark, "a b c d", "a b c d", None, ids=[None, None, None])
    out = fim.fill_in_middle(docs).collect()
    assert [r.output for r in out] == [slow_fim("a b c d", "")[4]] * 2 + [""]
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    assert "Exchange" not in fim.op13_fim(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
