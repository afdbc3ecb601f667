"""The registered queries with SQL, and the pipeline's stages, over the smallest tables."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievegrid.llm import mixing, packing, quality, queries, shared
from sievegrid.llm.shared import Table
from tests.llm.test_nearcopies import brute_force
from tests.llm.test_operators import clashing, documents, slow_features, slow_mix
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"pipeline", "op11_collisions"}))
def test_query_returns_a_row_for_each_row(spark, name):
    table = {"op2": "pages", "op8": "pages", "op6": "embeddings"}.get(name.split("_")[0], "documents")
    out = queries.QUERIES[name](spark, SF)
    assert out.count() >= spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Table(stage(spark, docs, SF), f"test-{name}").df
        after = docs.count()
        assert sorted(docs.columns) == sorted(columns) and 0 < after <= before, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert [r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect() if r.n > 4096] == []


def test_whole_copies_do_not_make_lines_frequent(spark):
    texts = ["only a\nonly b"] * 12 + [f"shared\nown {i}" for i in range(10)] + ["shared"] * 3
    out = corpus_pipeline.drop_lines(spark, documents(spark, *texts), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: ("only a\nonly b", 13) for i in range(12)} | {12 + i: (f"own {i}", 5) for i in range(10)}
    kept = corpus_pipeline.drop_near_copies(spark, out, "")
    assert [r.doc_id for r in kept.where("text = 'only a\\nonly b'").collect()] == [0]


def odd_table(spark):
    """Good and bad prose, shared lines, copies, near copies, shared and missing ids, null, blank and long texts."""
    rng = random.Random(21)
    good = [" ".join(rng.choices([f"river{i}" for i in range(400)], k=rng.randint(30, 80))) + "." for _ in range(40)]
    bad = [" ".join(w + "!!" for w in rng.choices("WIN CASH NOW".split(), k=40)) for _ in range(12)]
    lined = [f"Common line\n{g}\n common LINE " for g in good[:14]]
    near = [g.replace(" ", "  ", 1) + " end" for g in good[20:26]]
    texts = [*good, *bad, *lined, *near, good[30], good[30].upper(), None, "", " ", "Common line", "word " * 6000]
    ids = list(range(len(texts)))
    ids[3] = ids[4] = 2
    ids[5] = ids[-4] = None
    return documents(spark, *texts, *texts[:3], ids=ids + ids[:3])


def as_rows(frame):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in frame.collect())


def test_stages_match_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, with columns that clash with those that the operators make."""
    docs = odd_table(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(52)] + [(None, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    weights = quality.train(docs, labels)
    score = lambda text: quality.sigmoid(sum(weights[k] * v for k, v in slow_features(text).items()))
    kept = Table(corpus_pipeline.keep_quality(spark, clashing(docs).withColumn("quality_score", F.lit(1)), str(tmp_path)), "test").df
    rows = [r for r in rows if score(r[1]) >= quality.THRESHOLD]
    assert as_rows(kept) == Counter(rows) and 0 < len(rows) < docs.count()

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for text in {r[1] for r in rows if r[1] is not None} for k in {key(x) for x in text.split("\n")} if k)
    lined = []
    for i, text, lang, source in rows:
        parts = (text or "").split("\n")
        left = [x for x in parts if not key(x) or seen[key(x)] < 10]
        if len(left) == len(parts) or "\n".join(left):
            lined.append((i, text if len(left) == len(parts) else "\n".join(left), lang, source))
    kept = Table(corpus_pipeline.drop_lines(spark, clashing(kept), ""), "test").df
    assert as_rows(kept) == Counter(lined) != Counter(rows)

    # ids before rows without one; of rows that share an id the first read stays, whichever that is
    _, root = brute_force([r[1] for r in lined])
    first = {}
    for r, group in zip(lined, root):
        first.setdefault(group, set()).add((r[0] is None, r[0] or 0))
    kept = Table(corpus_pipeline.drop_near_copies(spark, clashing(kept), ""), "test").df
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept.collect()]
    group_of = {}
    for r, group in zip(lined, root):
        group_of.setdefault(r, group)
    assert Counter(group_of[r] for r in rows) == Counter(dict.fromkeys(root, 1))
    assert all((r[0] is None, r[0] or 0) == min(first[group_of[r]]) for r in rows)

    kept = Table(corpus_pipeline.mix_sources(spark, clashing(kept), ""), "test").df
    want = slow_mix(rows, corpus_pipeline.MIX_SHARE, 1)
    assert as_rows(kept) == Counter({(i, text, None if lang == mixing.NONE else lang, None if source == mixing.NONE else source): n for (i, text, lang, source, _), n in want.items()})
    assert kept.columns == docs.columns

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    cut = Counter()
    for i, text, _, _ in as_rows(kept):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        cut.update((i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[k : k + 4096]))) for k in range(0, len(ids), 4096))
    out = corpus_pipeline.pack_sequences(spark, clashing(kept), "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == cut
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096 and len(filled) <= -(-sum(filled.values()) // 4096) + 1


def test_stages_of_empty_tables(spark, tmp_path):
    docs = documents(spark, "x").where("false")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_run_keeps_one_of_each_text_and_no_superseded_table(spark, tmp_path, monkeypatch):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    documents(spark, a, a, a, b, a, ids=[1, 5, 1, 5, None]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (5, b)]
    folder = f"{tmp_path}/shared"
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"file://{folder}")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= {1, 5}
    assert {x.rpartition("-")[0] for x in os.listdir(folder)} == {"stage-mixing", "pieces"}
