"""Han words: statistics by counting, splits against all splits tried one by one, and BM25 over split texts."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievegrid.operators import bm25, segment

WORDS = ["期权", "合约", "行权价格", "到期日", "的", "和", "保证金", "持仓", "限额"]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "child_id long, text string, word string")


def corpus(rng, n=300):
    return ["".join(rng.choices(WORDS, k=rng.randrange(3, 12))) + rng.choice(["。", "，A股", " "]) + "".join(rng.choices(WORDS, k=4)) for _ in range(n)]


def slow_statistics(rows, longest=4):
    found, before, after = Counter(), {}, {}
    for t in rows:
        run = ""
        for c in (t or "") + " ":
            if "一" <= c <= "鿿":
                run += c
                continue
            for i in range(len(run)):
                for n in range(1, min(longest, len(run) - i) + 1):
                    w = run[i : i + n]
                    found[w] += 1
                    before.setdefault(w, []).append(run[i - 1] if i else ("edge", len(before.get(w, []))))
                    after.setdefault(w, []).append(run[i + n] if i + n < len(run) else ("edge", len(after.get(w, []))))
            run = ""
    total = sum(n for w, n in found.items() if len(w) == 1)
    entropy = lambda seen: -sum(n / len(seen) * math.log(n / len(seen)) for n in Counter(seen).values())
    out = {}
    for w, n in found.items():
        cohesion = min((math.log(n * total / (found[w[:i]] * found[w[i:]])) for i in range(1, len(w))), default=None)
        out[w] = (n, cohesion, min(entropy(before[w]), entropy(after[w])))
    return out


def slow_split(run, costs, unknown):
    """All splits, the cheapest; among equals the one with the longest first word, and so on."""

    def splits(rest):
        if not rest:
            yield 0, ()
        for n in range(1, min(4, len(rest)) + 1):
            cost = costs.get(rest[:n], unknown if n == 1 else None)
            if cost is not None:
                for more, words in splits(rest[n:]):
                    yield cost + more, (rest[:n], *words)

    return list(min(splits(run), key=lambda s: (s[0], [-len(w) for w in s[1]]))[1])


def test_statistics_match_counting(spark):
    rows = corpus(random.Random(1), 60) + [None, "", "abc", "期", "期权期权期权"]
    got = {r.word: r for r in segment.statistics(texts(spark, rows)).collect()}
    want = slow_statistics(rows)
    assert set(got) == set(want)
    for w, (n, cohesion, freedom) in want.items():
        assert got[w].n == n and got[w].freedom == pytest.approx(freedom, abs=2e-6), w
        assert (got[w].cohesion is None) == (cohesion is None) and (cohesion is None or got[w].cohesion == pytest.approx(cohesion, abs=2e-6)), w


def test_dictionary_finds_words(spark):
    """Words that texts are made of are learnt, and texts fall into them again."""
    rows = corpus(random.Random(2), 400)
    words = segment.dictionary(segment.statistics(texts(spark, rows))).cache()
    learnt = {r.word for r in words.collect() if len(r.word) > 1}
    assert {w for w in WORDS if len(w) > 1} <= learnt
    split = {r.run: r.words for r in segment.split_runs(spark.createDataFrame([("期权合约的行权价格和到期日",), ("保证金",)], "run string"), words).collect()}
    assert split == {"期权合约的行权价格和到期日": ["期权", "合约", "的", "行权价格", "和", "到期日"], "保证金": ["保证金"]}


def test_splits_match_all_splits(spark):
    rng = random.Random(3)
    letters = "甲乙丙丁戊"
    costs = {"".join(rng.choices(letters[:4], k=rng.randrange(1, 5))): rng.randrange(1, 6) for _ in range(40)}
    words = spark.createDataFrame(list(costs.items()), "word string, cost long")
    unknown = max(costs.values()) + int(segment.COST_SCALE * math.log(2))
    runs = {"".join(rng.choices(letters, k=rng.randrange(1, 11))) for _ in range(150)} | {"戊"}
    got = {r.run: r.words for r in segment.split_runs(spark.createDataFrame([(r,) for r in runs] * 2, "run string"), words).collect()}
    assert got == {run: slow_split(run, costs, unknown) for run in runs}
    assert segment.split_runs(spark.createDataFrame([("甲乙",)], "run string"), words.where("false")).first().words == ["甲", "乙"]
    assert segment.split_runs(spark.createDataFrame([], "run string"), words).count() == 0


def test_long_runs_take_linear_time(spark):
    words = spark.createDataFrame([("甲乙", 1), ("甲", 5)], "word string, cost long")
    row = segment.split_runs(spark.createDataFrame([("甲乙" * 20_000 + "丙",)], "run string"), words).first()
    assert row.words == ["甲乙"] * 20_000 + ["丙"]


def test_tokens_keep_the_order_of_a_text(spark):
    words = spark.createDataFrame([("期权", 1), ("合约", 1)], "word string, cost long")
    out = segment.tokens(texts(spark, ["期权ABC合约 x1期，期权期权", None, "", "!?"]), words).orderBy("id", "pos", "sub").collect()
    assert [(r.id, r.term) for r in out] == [(0, t) for t in ["期权", "abc", "合约", "x1", "期", "期权", "期权"]]


def test_known_words(spark):
    found = segment.statistics(texts(spark, ["甲乙丙"] * 3))
    known = spark.createDataFrame([("甲乙", 10_000)], "word string, n long")
    assert "甲乙" not in {r.word for r in segment.dictionary(found).collect()}
    assert [r.words for r in segment.split_runs(spark.createDataFrame([("甲乙丙",)], "run string"), segment.dictionary(found, known=known)).collect()] == [["甲乙", "丙"]]


def test_bm25_over_words(spark):
    """An index of split texts gives what one of the same texts with blanks between their words gives."""
    rng = random.Random(4)
    parts = [[rng.choice(WORDS) for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    words = spark.createDataFrame([(w, 1) for w in WORDS], "word string, cost long")
    kids, spaced = texts(spark, ["，".join(p) for p in parts]), texts(spark, [" ".join(p) for p in parts])
    asked = spark.createDataFrame([(1, "期权 合约"), (2, "行权价格 和 期权 期权"), (3, "无")], "query_id long, text string")
    counted = segment.tokens(asked, words, "query_id").groupBy(F.col("id").alias("query_id"), "term").agg(F.count("*").alias("times"))
    got = bm25.search(bm25.build_from_terms(kids, segment.tokens(kids, words)), counted, 20)
    want = bm25.search(bm25.build(spaced), asked.withColumn("text", F.col("text")), 20)
    assert sorted(map(tuple, got.select("query_id", "child_id", "score", "ord").collect())) == sorted(map(tuple, want.select("query_id", "child_id", "score", "ord").collect()))


def test_counts_do_not_depend_on_stretches():
    """Strings are counted where they begin, so those across a stretch's end count once."""
    rng = random.Random(5)
    codes = segment._codes(["".join(rng.choices("甲乙丙，", k=200)) for _ in range(3)] + ["", "x"])
    for at_once in (7, 64, 10_000):
        got = Counter()
        for start in range(0, len(codes), at_once):
            for chars, n in segment._counted(codes[start : start + at_once + 4], at_once, 5):
                got.update(dict(zip(segment._written(chars).to_pylist(), n.tolist())))
        text = "".join(chr(c + 0x4DFF) if c else " " for c in codes.tolist())
        assert got == Counter(run[i : i + n] for run in text.split() for i in range(len(run)) for n in range(1, 6) if i + n <= len(run))


def test_runs_split_together_as_alone(monkeypatch):
    rng = random.Random(6)
    costs = {"".join(rng.choices("甲乙丙丁", k=rng.randrange(1, 5))): rng.randrange(1, 6) for _ in range(40)} | {"甲A": 1, "甲乙丙丁甲": 1}
    words = pa.table({"word": list(costs), "cost": list(costs.values())})
    runs = ["".join(rng.choices("甲乙丙丁戊", k=rng.randrange(1, 11))) for _ in range(80)]
    splitter = segment.Splitter(words, 4)
    want = [slow_split(run, {w: c for w, c in costs.items() if len(w) < 5}, splitter.unknown) for run in runs]
    for alone in (0, 3, 1000):
        monkeypatch.setattr(segment, "ALONE", alone)
        found, n = splitter.split(pa.array(runs))
        assert found.to_pylist() == [w for words in want for w in words] and n.tolist() == [len(w) for w in want]


def test_texts_are_cut_where_they_lie(spark, monkeypatch):
    """No row moves to be split; a dictionary too large to be sent is joined and gives the same."""
    rows = texts(spark, corpus(random.Random(7), 40) + ["㐀期权ABC合约 x1期，期权期权", None, "", "!?", "a"])
    words = spark.createDataFrame([(w, 1) for w in WORDS], "word string, cost long")
    cut, lists = segment.tokens(rows, words), segment.term_lists(rows, words)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted(map(tuple, cut.collect())), sorted((r.id, tuple(r.terms)) for r in lists.collect())
    monkeypatch.setattr(segment, "MOST_SENT", 0)
    assert "Join" in segment.tokens(rows, words)._jdf.queryExecution().executedPlan().toString()
    assert got == (sorted(map(tuple, segment.tokens(rows, words).collect())), sorted((r.id, tuple(r.terms)) for r in segment.term_lists(rows, words).collect()))
    assert dict(got[1])[40] == ("㐀", "期权", "abc", "合约", "x1", "期", "期权", "期权") and dict(got[1])[41] == ()


def test_lists_score_as_texts(spark, monkeypatch):
    """Products in tasks give what the join gives, with no row for each term that a document shares with a question."""
    rng = random.Random(8)
    parts = [[rng.choice(WORDS) for _ in range(rng.randrange(0, 9))] for _ in range(120)] + [["期权"]] * 3
    lists = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "id long, terms array<string>").repartition(3)
    asked = spark.createDataFrame([(1, "期权", 1), (1, "合约", 2), (2, "行权价格", 1), (2, "和", 3), (3, "无", 1)], "query_id long, term string, times long")
    want = bm25.search(bm25.build(lists, "id", "terms", split=True), asked, 20)
    got = bm25.search_lists(lists, asked, 20)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert bm25.search_lists(lists, asked.where("query_id = 3"), 20).count() == 0
    monkeypatch.setattr(bm25, "CELLS", 1)
    assert sorted(map(tuple, bm25.search_lists(lists, asked, 20).select(got.columns).collect())) == sorted(map(tuple, got.collect()))
