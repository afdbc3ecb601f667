from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import generation, titles


@pytest.mark.parametrize(("raw", "clean"), [("如何开户？|中国金融期货交易所", "如何开户？"), ("上证50ETF期权合约基本条款 | 上海证券交易所", "上证50ETF期权合约基本条款"), ("规则_深圳证券交易所 - SGX", "规则"), ("a | b", "a"), (None, "")])
def test_cleaned_title(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(titles.cleaned_title(F.col("t")).alias("v")).first().v == clean


def test_title_precedence(spark):
    docs = spark.createDataFrame([("a", "parsed", None, None), ("b", "b", "title=from notes|x", None), ("c", "", None, "PDF title long"), ("d", None, None, "tiny"), ("e", "parsed | SGX", None, None)], "doc_id string, title string, notes string, pdf_title string")
    named = spark.createDataFrame([("a", " listed ")], "doc_id string, title string")
    out = {r.doc_id: r.doc_title for r in titles.resolved_titles(docs, named).collect()}
    assert out == {"a": "listed", "b": "from notes", "c": "PDF title long", "d": "d", "e": "parsed"}


def test_section_paths(spark):
    text = "前言\n第一章 总则\n一\n第一节 范围\n二\n第二章 交易\n三\n第一编 新编\n四"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    out = {r.line: r.path for r in titles.section_paths(docs).collect()}
    assert out["前言"] == [] and out["一"] == ["第一章 总则"] and out["二"] == ["第一章 总则", "第一节 范围"]
    assert out["三"] == ["第二章 交易"] and out["四"] == ["第一编 新编"]


def test_budgets():
    assert [generation.output_budget(x) for x in (None, 100, 5000)] == [2048, 1024, 5000]
    assert [generation.retry_budget(x) for x in (1024, 10_000, 16_384)] == [3072, 16_384, None]


def test_expansion_and_rewriting(spark):
    queries = spark.createDataFrame([(1, "q one", [("user", "before")]), (2, "q two", [])], "query_id long, text string, history array<struct<role string, text string>>")
    out = generation.expanded(queries, [lambda m: F.lit("<think>x</think>made up"), lambda m: F.lit("")]).collect()
    assert sorted((r.query_id, r.variant, r.text) for r in out) == [(1, 0, "q one"), (1, 1, "made up"), (2, 0, "q two"), (2, 1, "made up")]
    assert {r.query_id: r.text for r in generation.rewritten(queries, lambda m: F.lit("alone")).collect()} == {1: "alone", 2: "q two"}
