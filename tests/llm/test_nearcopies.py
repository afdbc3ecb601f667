"""The pipeline's near-copy stage against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sievegrid.llm import nearcopies
from tests.llm.test_operators import documents, union_find


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def planted(seed=1, families=40):
    """Texts with copies of which some are within and some just outside 0.8."""
    rng = random.Random(seed)
    texts = []
    for family in range(families):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.randint(1, 4) // 100)):
                copy[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


def brute_force(texts):
    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    return pairs, union_find(len(texts), pairs)


def test_near_copies_of_similarity_four_fifths_go(spark):
    texts = planted() + ["a b", "A  B", None, "", " \n", "c d e f"]
    pairs, root = brute_force(texts)
    sets = [grams(t) for t in texts]
    assert sum(similarity(sets[a], sets[b]) < 0.9 for a, b in pairs) >= 10
    out = corpus_pipeline.drop_near_copies(spark, documents(spark, *texts), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root))


def test_groups_take_few_rounds_or_all_pairs_alike(spark, monkeypatch):
    """A base whose copies are similar to it, but often not to each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"y{rng.random()}" if i in at else w for i, w in enumerate(base)) for at in (set(rng.sample(range(100), 2)) for _ in range(60))]
    pairs, root = brute_force(texts)
    assert len(set(root)) < 60
    rows = documents(spark, *texts).select(F.col("doc_id").alias("row_id"), "text")
    for small, stars, sent in ((1, 1, 0), (1, 3, 1 << 20), (16, 2, 1 << 20)):
        monkeypatch.setattr(nearcopies, "MOST_SENT", sent)
        out = {r.row_id: r.group_id for r in nearcopies.groups(rows, small=small, stars=stars).collect()}
        assert union_find(60, list(out.items())) == root, (small, stars)


def test_tiles_find_the_similar_sets(monkeypatch):
    rng = random.Random(8)
    sets = [np.unique(np.array(rng.choices(range(30), k=rng.randint(0, 30)), dtype=np.int64)) for _ in range(50)]
    want = {(i, j) for i, a in enumerate(sets[:20]) for j, b in enumerate(sets) if len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))}
    for cells in (8, 200, 1 << 20):
        monkeypatch.setattr(nearcopies, "_CELLS", cells)
        assert set(nearcopies.similar_rows(sets[:20], sets, 0.5)) == want


def test_rows_that_share_or_lack_an_id(spark):
    texts = ["a b c d e f"] * 3 + ["g h i j k l"] * 2 + ["a b c d e f", "m n o p q r"]
    out = corpus_pipeline.drop_near_copies(spark, documents(spark, *texts, ids=[5, 5, 7, None, None, 3, 7]), "")
    assert sorted((r.text, r.doc_id) for r in out.collect()) == [("a b c d e f", 3), ("g h i j k l", None), ("m n o p q r", 7)]
