"""Behaviour of the text, numeral and vector functions on literal cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import numerals, vectors
from sievegrid.functions import text as tx
from sievegrid.operators import evaluation


def value(spark, column, **cells):
    frame = spark.range(1)
    for name, v in cells.items():
        frame = frame.withColumn(name, F.lit(v))
    return frame.select(column.alias("v")).first().v


def on(spark, f, text):
    return value(spark, f(F.col("x")), x=text)


@pytest.mark.parametrize(("raw", "clean"), [("上证 50 ETF", "上证50 ETF"), ("合约 单位 为 10000 份", "合约单位为10000份"), ("第 5 条", "第5条"), ("plain English text", "plain English text")])
def test_cjk_gaps(spark, raw, clean):
    assert on(spark, tx.close_cjk_gaps, raw) == clean


def test_clean_text(spark):
    assert on(spark, tx.clean_text, "a \r\n\n\n\n- 12 -\nb​") == "a\n\nb"
    assert on(spark, tx.clean_text, None) == ""


@pytest.mark.parametrize(
    ("text", "number"),
    [("上证发〔2023〕48号 通知", "上证发〔2023〕48号"), ("上证发 〔2023〕48号", "上证发〔2023〕48号"), ("上证发　〔2023〕48号", "上证发〔2023〕48号"), ("〔2019〕第 3 号", "〔2019〕第3号"), ("没有文号", None), ("〔1823〕48号", None)],
)
def test_document_number(spark, text, number):
    assert on(spark, tx.document_number, text) == number


def test_dates_and_status(spark):
    assert on(spark, tx.effective_date, "本规则自 2026 年 5 月 1 日起施行。") == "2026-05-01"
    assert on(spark, tx.effective_date, "自即日起") is None
    for title, status in (("某规则（已废止）", tx.REPEALED), ("某规则（修订版）", tx.SUPERSEDED), ("上证发〔2023〕48号", tx.ACTIVE), ("某规则", tx.UNKNOWN)):
        assert value(spark, tx.effective_status(F.col("t"), F.col("x")), t=title, x="") == status


@pytest.mark.parametrize(("numeral", "n"), [("一", 1), ("十", 10), ("十一", 11), ("二十", 20), ("一百零三", 103), ("一百一十", 110), ("一百七十", 170), ("两千", 2000), ("12", 12), ("abc", None)])
def test_chinese_number(spark, numeral, n):
    assert on(spark, tx.chinese_number, numeral) == n


@pytest.mark.parametrize("n", [1, 7, 10, 15, 42, 99, 100, 103, 110, 156, 1003, 9999])
def test_numeral_round_trip(spark, n):
    made = on(spark, numerals.to_chinese, n)
    assert on(spark, tx.chinese_number, made) == n


def test_labels(spark):
    assert value(spark, numerals.to_roman(F.col("x")), x=1994) == "MCMXCIV"
    assert [value(spark, numerals.list_label(F.col("x"), f), x=3) for f in ("decimal", "upperLetter", "lowerRoman", "decimalEnclosedCircle", "bullet")] == ["3", "C", "iii", "③", ""]


@pytest.mark.parametrize(
    ("text", "parts"),
    [("第一句。第二句！第三", ["第一句。", "第二句！", "第三"]), ("One here. Two there. three", ["One here.", "Two there. three"]), ("a\n\nb", ["a", "b"]), ("", [])],
)
def test_sentences(spark, text, parts):
    assert on(spark, tx.sentences, text) == parts


def test_references(spark):
    q = "《上海证券交易所交易规则》第十二条和上证发〔2023〕48号，IO2406 与 510050"
    assert value(spark, tx.references(F.col("x"), "title"), x=q) == ["上海证券交易所交易规则"]
    assert value(spark, tx.references(F.col("x"), "clause"), x=q) == ["第十二条"]
    assert value(spark, tx.references(F.col("x"), "doc_no"), x=q)[0].endswith("〔2023〕48号")
    assert value(spark, tx.references(F.col("x"), "code"), x="see 510050 or IO2406 now") == ["510050", "IO2406"]


@pytest.mark.parametrize(("title", "yes"), [("期权是什么？| 某交易所", True), ("如何办理开户手续", True), ("交易规则全文", False), ("什么", False)])
def test_question_title(spark, title, yes):
    assert on(spark, tx.is_question_title, title) is yes


def test_small_text_functions(spark):
    assert on(spark, tx.host_of, "https://www.Example.org:8080/a?b") == "example.org:8080"
    assert on(spark, tx.squeezed, " a（b）　c ") == "a(b)c"
    assert on(spark, tx.without_thinking, "<think>x</think> answer") == "answer"
    assert on(spark, tx.without_thinking, "<think>never ends") == ""
    assert on(spark, tx.slug, "") == "untitled"
    assert value(spark, tx.rewritten_or_original(F.col("r"), F.col("q")), r="x\n“better”", q="question") == "better"
    assert value(spark, tx.rewritten_or_original(F.col("r"), F.col("q")), r="y" * 100, q="short") == "short"
    assert [tuple(x) for x in on(spark, tx.json_pairs, '```json\n[{"question": "q", "answer": "a"}]\n```')] == [("q", "a")]
    assert on(spark, tx.json_pairs, "no list") is None
    assert value(spark, tx.trim_boilerplate(F.col("x"), ("END", "STOP"), ("TOP",)), x="aTOP body STOP tail END") == "body"


def test_vectors(spark):
    assert value(spark, vectors.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))) == pytest.approx(0.96)
    assert value(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    a, b = F.create_map(F.lit("x"), F.lit(2.0), F.lit("y"), F.lit(1.0)), F.create_map(F.lit("x"), F.lit(3.0))
    assert value(spark, vectors.sparse_dot(a, b)) == 6.0
    assert value(spark, vectors.sigmoid(F.col("x")), x=800.0) == 1.0
    assert value(spark, vectors.sigmoid(F.col("x")), x=-800.0) == 0.0
    assert value(spark, vectors.sigmoid(F.col("x")), x=3.0) == pytest.approx(1 / (1 + math.exp(-3)))


def test_answer_checks(spark):
    assert value(spark, evaluation.numeric_fidelity(F.col("a"), F.col("g")), a="10,000 份", g="合约单位为 10000 份，3.5%") == 0.5
    assert value(spark, evaluation.numeric_fidelity(F.col("a"), F.col("g")), a="x", g="none") is None
    assert value(spark, evaluation.keyword_coverage(F.col("a"), F.col("g")), a="alpha", g="alpha beta") == 0.5


def test_value_at_is_by_index(spark):
    for n, want in ((20, 20), (10, 10), (1, 1), (1000, 951), (50_000, 47_501)):
        assert [tuple(r) for r in evaluation.value_at(spark.range(1, n + 1), "id", ()).collect()] == [(n, want)]
    rows = spark.sql("SELECT k, IF(id % 3 = 0, NULL, CAST(pow(id % 50, 3) AS DOUBLE)) AS v FROM range(3000) LATERAL VIEW explode(array('a', 'b', NULL)) AS k")
    want = sorted(float((i % 50) ** 3) for i in range(3000) if i % 3)
    assert {(r.k, r.n, r.v) for r in evaluation.value_at(rows, "v", ("k",)).collect()} == {(k, 2000, want[1900]) for k in ("a", "b", None)}
    assert evaluation.value_at(rows.where("false"), "v", ("k",)).count() == 0
