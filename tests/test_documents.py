"""Chunking, mining, sources and streaming on literal cases."""

from __future__ import annotations

import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import chunking, mining
from sievegrid.sources import content, docx, html, jsonl, schemas
from sievegrid.streaming import events

DOC = "doc_id string, doc_title string, text string, tables array<struct<n_cols int, rows array<array<string>>>>"


def doc(spark, text, title="某期权合约基本条款", tables=()):
    return spark.createDataFrame([("d", title, text, list(tables))], DOC)


def test_clauses(spark):
    text = "总则\n第一条 为了规范交易行为制定本规则。\n第二条 交易者应当遵守，见第三款和第二项。\n第三条 本规则由交易所解释说明。\n第四条 本规则自发布之日起施行。"
    out = chunking.clauses(doc(spark, text)).orderBy("position").collect()
    assert [r.clause_id for r in out] == ["第一条", "第二条", "第三条", "第四条"]
    assert chunking.clauses(doc(spark, "第一条 只有一条的文件内容。")).count() == 0


def test_english_rules(spark):
    text = "\n".join(f"7.0{i}.1 Exercise of contracts under this rule number {i}" for i in range(1, 5))
    assert [r.clause_id for r in chunking.english_rules(doc(spark, text)).orderBy("position").collect()] == [f"7.0{i}.1" for i in range(1, 5)]


def test_table_facts(spark):
    rows = chunking.table_facts(doc(spark, "", tables=[(2, [["合约单位", "10000份"], ["行权方式", "欧式"], ["", "x"]]), (3, [["a", "b", "c"]])])).orderBy("position").collect()
    assert [r.text for r in rows] == ["某期权的合约单位：10000份", "某期权的行权方式：欧式"]


def test_questions(spark):
    text = "1. 什么是期权？\n答：期权是一种合约。\n2、如何行权？\n到期日提交指令。"
    out = chunking.questions(doc(spark, text)).orderBy("position").collect()
    assert [r.text for r in out] == ["问：什么是期权？\n答：期权是一种合约。", "问：如何行权？\n答：到期日提交指令。"]
    alone = chunking.questions(doc(spark, "携带身份证到营业部办理即可。", title="如何办理开户手续")).collect()
    assert [r.clause_id for r in alone] == ["问答1"]


def test_prose_packs_paragraphs(spark):
    text = "\n\n".join("段落" + str(i) + "字" * 50 for i in range(10))
    out = chunking.prose(doc(spark, text), most=120).collect()
    assert all(len(r.text) <= 120 for r in out)
    assert "".join(sorted("".join(r.text for r in out).replace("\n", ""))) == "".join(sorted(text.replace("\n", "")))


def test_children_pack_sentences(spark):
    parts = [f"这是第{i}句内容完整的话。" for i in range(40)]
    parents = spark.createDataFrame([("p", "d", "".join(parts), "prose"), ("q", "d", "短文。", "prose")], "parent_id string, doc_id string, text string, chunk_type string")
    out = chunking.children(parents, target=200, most=300, least=50).orderBy("parent_id", "position").collect()
    long_ = [r.text for r in out if r.parent_id == "p"]
    assert all(len(t) <= 300 for t in long_) and len(long_) > 2
    assert all(any(s in t for t in long_) for s in parts)
    assert [r.text for r in out if r.parent_id == "q"] == ["短文。"]


def test_cuts_are_computed_once_for_a_row(spark):
    """A text of many sentences takes time by their number, not by its third power."""
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.concat(F.lit("Some sentence "), i.cast("string"))).alias("parts"))
    rows = rows.withColumn("far", F.transform("parts", lambda s, i: F.when(i % 10 == 9, 0.9).otherwise(0.1)))
    began = time.monotonic()
    packs = rows.select(chunking.packed_sentences(F.col("parts"), chunking.breakpoints(F.col("far")), 300, 512, 80, 0).alias("p")).first().p
    assert time.monotonic() - began < 20
    assert [p.rsplit(" ", 1)[1] for p in packs[:3]] == ["10", "20", "30"]


def test_breakpoints(spark):
    out = spark.range(1).select(chunking.breakpoints(F.array(*[F.lit(x) for x in (0.1, 0.1, 0.9, 0.1)])).alias("v")).first().v
    assert out == [2]


def test_mining(spark):
    facts = chunking.table_facts(doc(spark, "", "甲合约条款", [(2, [["合约单位", "100"], ["合约标的", "铜"]])])).unionByName(chunking.table_facts(doc(spark, "", "乙合约条款", [(2, [["合约单位", "200"], ["合约标的", "铜"]])]).withColumn("doc_id", F.lit("e"))))
    made = mining.template_pairs(facts).collect()
    assert len(made) == 10 and len({r.qa_id for r in made}) == 10
    compared = mining.comparison_pairs(facts).collect()
    assert len(compared) == 1 and "有什么区别？" in compared[0].question and "100" in compared[0].answer and "200" in compared[0].answer
    pairs = chunking.questions(doc(spark, "1. 什么是期权合约？\n答：期权是一种合约。"))
    assert [(r.question, r.answer) for r in mining.written_pairs(pairs).collect()] == [("什么是期权合约？", "期权是一种合约。")]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (("table_row", "甲", "单位", "x"), ("table_row", "乙", "单位", "x"), False),
        (("table_row", "甲", "单位", "x"), ("table_row", "甲", "单位", "y"), True),
        (("clause", "", "", "字" * 40), ("clause", "", "", "前" + "字" * 40), True),
        (("clause", "", "", "短句"), ("clause", "", "", "短句之外还有"), False),
    ],
)
def test_same_fact(spark, a, b, same):
    lits = [F.lit(x) for x in (*a, *b)]
    assert spark.range(1).select(mining.same_fact(*lits).alias("v")).first().v is same


def test_balanced_metadata_and_records(spark):
    rows = spark.sql("SELECT array(named_struct('doc_title', 'a', 'text', 'x'), named_struct('doc_title', '', 'text', 'y')) AS r, array('n1', 'n2') AS neg, array(named_struct('doc_title', 't', 'clause_id', 'c')) AS meta")
    out = rows.select(mining.balanced_metadata(F.col("r")).alias("r"), mining.records_of(F.col("neg"), F.col("meta"), 2).alias("m")).first()
    assert [x.doc_title for x in out.r] == ["", ""] and out.m == []


def test_tolerant_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"qa_id": "1", "question": "q", "parent_id": "p", "tier": 1}\nnot json\n{"qa_id": "2", "tier": "wrong", "parent_id": ""}\n')
    rows = jsonl.read_jsonl(spark, str(path), schemas.PAIR).orderBy("qa_id").collect()
    assert [(r.qa_id, r.tier) for r in rows] == [("1", 1), ("2", None)]
    assert jsonl.read_jsonl(spark, str(tmp_path / "missing"), schemas.PAIR).count() == 0
    assert jsonl.read_gold(spark, str(path)).count() == 1
    jsonl.write_jsonl(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"a": 1, "b": None}


def test_manifest_last_success_wins(spark, tmp_path):
    rows = [{"id": "a", "status": "ok", "local_path": "1"}, {"id": "a", "status": "skipped", "local_path": "2"}, {"id": "a", "status": "failed", "local_path": ""}, {"id": "b", "status": "failed", "local_path": ""}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [(r.id, r.local_path) for r in jsonl.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == [("a", "2")]


def test_content_checks(spark):
    rows = [(1, b"", "text/html", "html"), (2, b"x" * 10648, "text/html", "html"), (3, b"%PDF-1.4", "text/html", "pdf"), (4, b"nope", "application/pdf", "pdf"), (5, b"<html>", "text/html", "html"), (6, b"%PDF-1.4", "application/pdf", "pdf")]
    frame = spark.createDataFrame(rows, "id int, content binary, content_type string, expect string")
    out = frame.select("id", content.rejection(F.col("content"), F.col("content_type"), F.col("expect")).alias("r")).orderBy("id").collect()
    assert [r.r for r in out] == ["empty", "blocked", "content_type", "magic", "too_short", None]


def test_decoding(spark):
    frame = spark.createDataFrame([("期权".encode(),), ("期权".encode("gb18030"),), (None,)], "content binary")
    assert [r.t for r in frame.select(content.decoded("content").alias("t")).collect()] == ["期权", "期权", None]


def test_html_and_links(spark):
    page = "<html><head><title>A &amp; B</title></head><body><nav><a href='/m'>menu</a></nav><div class='ad'>buy</div><h1>Head</h1><p>One <b>two</b></p><table><tr><td>k</td><td>v</td></tr></table><footer>end</footer></body></html>"
    frame = spark.createDataFrame([("https://x.org/d/e.html", page)], "url string, html string")
    out = frame.select(html.title(F.col("html")).alias("t"), html.paragraphs(F.col("html")).alias("p"), html.tables(F.col("html")).alias("c"), html.text_with_tables(F.col("html")).alias("x")).first()
    assert out.t == "A & B" and out.p == ["Head", "One two", "k", "v"] and out.c == [[["k", "v"]]] and out.x == "Head\nOne two\n\nk：v"
    two = spark.createDataFrame([("https://x.org/d/e.html", "<a href='f.html'>F</a><a href='/g'>G</a><a href='/g'>again</a><a href='https://y.org/'>Y</a>")], "url string, html string")
    assert [(r.url, r.title) for r in content.links(two).orderBy("ord").collect()] == [("https://x.org/d/f.html", "F"), ("https://x.org/g", "G"), ("https://y.org/", "Y")]


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def p(text, level=None):
        number = f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="5"/></w:numPr></w:pPr>' if level is not None else ""
        return f"<w:p>{number}<w:r><w:t>{text}</w:t></w:r></w:p>"

    body = p("title") + p("one", 0) + p("sub", 1) + p("sub", 1) + p("two", 0) + p("sub", 1) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    levels = '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="chineseCounting"/><w:lvlText w:val="第%1条"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1.%2"/></w:lvl>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="9">{levels}</w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="9"/></w:num></w:numbering>')
    files = spark.createDataFrame([("a.docx", raw.getvalue()), ("bad.docx", b"zip?")], "path string, content binary")
    blocks = docx.read_docx_blocks(files).cache()
    assert [r.text for r in docx.numbered_paragraphs(blocks).orderBy("ord").collect()] == ["title", "第一条 one", "1.1 sub", "1.2 sub", "第二条 two", "2.1 sub"]
    assert blocks.where("kind = 'table'").first().cells == [["k", "v"]]
    assert blocks.where("kind = 'error'").count() == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.sql("SELECT 1L AS session_id, id AS turn, concat('t', id) AS text FROM range(30)").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema("session_id long, turn long, text string").parquet(str(tmp_path / "in/a"))
    memory = events.conversation_memory(stream).writeStream.outputMode("update").format("memory").queryName("memory_test").option("checkpointLocation", str(tmp_path / "c1")).start()
    until = time.time() + 60  # timers keep such a query busy, so it never says that all is done
    while spark.table("memory_test").isEmpty() and time.time() < until:
        time.sleep(0.5)
    memory.stop()
    assert spark.table("memory_test").first().n == 20
    children = spark.sql("SELECT concat('c', id) AS child_id, CASE WHEN id = 3 THEN 'rare words' ELSE 'common words' END AS text FROM range(8)")
    children.write.parquet(str(tmp_path / "in/b"))
    growing = events.grow_index(spark.readStream.schema("child_id string, text string").parquet(str(tmp_path / "in/b")), str(tmp_path / "index"), str(tmp_path / "c2"))
    growing.awaitTermination(120)
    from sievegrid.operators import bm25

    queries = spark.createDataFrame([(1, "rare")], "query_id long, text string")
    assert [r.child_id for r in bm25.search(events.grown_index(spark, str(tmp_path / "index")), queries).collect()] == ["c3"]
