"""Registered queries for what rulebooks bring: clauses, rules, questions, tables, titles, numerals, references, markers.

The driver tables hold no rulebook, so its texts are made of columns of ``part`` and ``supplier``. The SQL counterparts
start from the same columns and say what must come out, without splitting the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.functions import numerals
from sievegrid.functions import text as tx
from sievegrid.functions.vectors import cosine
from sievegrid.operators import bm25, chunking, context, dedup, evaluation, generation, keyword, mining, profile, titles
from sievegrid.plans import catalog, search
from sievegrid.plans.catalog import query, table
from sievegrid.sources import content, html, page_tree
from sievegrid.sources.folders import new_path, spread

NINE = "一二三四五六七八九"


def sha_sql(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || sha256({' || chr(31) || '.join(parts)})[:16]"


def _digit(n: Column) -> Column:
    return F.substring(F.lit(NINE), n.cast("int"), F.lit(1))


def _parts(spark, sf_dir):
    """(k, doc_id, doc_title, name) of each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doc_id"), F.concat("p_brand", F.lit("合约条款")).alias("doc_title"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size")


PARTS_SQL = "parts AS (SELECT p_partkey AS k, 'd' || p_partkey AS doc_id, p_brand || '合约条款' AS doc_title, p_name AS name, p_brand, p_type, p_size FROM part)"


# --- splitting ---------------------------------------------------------------------------------------------------
def _clause_texts(spark, sf_dir):
    lines = F.transform(F.sequence(F.lit(1), (F.col("k") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("第"), _digit(i), F.lit("条 "), F.col("name"), F.when(i == 2, "见第九条款项").otherwise("。")))
    return _parts(spark, sf_dir).select("doc_id", "doc_title", F.concat(F.lit("总则\n"), F.array_join(lines, "\n")).alias("text"))


@query(f"""
WITH {PARTS_SQL}, one AS (SELECT *, unnest(range(1, k % 4 + 2)) AS i FROM parts WHERE k % 4 >= 2),
made AS (SELECT *, '第' || substr('{NINE}', i::integer, 1) || '条' AS clause_id, '第' || substr('{NINE}', i::integer, 1) || '条 ' || name || CASE WHEN i = 2 THEN '见第九条款项' ELSE '。' END AS text FROM one)
SELECT {sha_sql("p_", "doc_id", "clause_id", "(i - 1)")} AS parent_id, doc_id, text, doc_title, clause_id, 'clause' AS chunk_type, (i - 1)::integer AS position FROM made
WHERE length(text) >= 10 AND NOT (length(text) < 25 AND NOT regexp_matches(text, '[。；！？.;]$'))""")
def clauses(spark, sf_dir):
    """Documents of three clauses at least; a reference to a paragraph of a clause starts none."""
    return chunking.clauses(_clause_texts(spark, sf_dir))


@query(f"""
WITH {PARTS_SQL}, one AS (SELECT *, unnest(range(1, k % 5 + 2)) AS i FROM parts WHERE k % 5 >= 2),
made AS (SELECT *, '7.' || i || '.1A' AS clause_id, '7.' || i || '.1A Exercise of ' || name AS text FROM one)
SELECT {sha_sql("p_", "doc_id", "clause_id", "(i - 1)")} AS parent_id, doc_id, text, doc_title, clause_id, 'clause' AS chunk_type, (i - 1)::integer AS position FROM made WHERE length(text) >= 25""")
def english_rules(spark, sf_dir):
    lines = F.transform(F.sequence(F.lit(1), (F.col("k") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("7."), i.cast("string"), F.lit(".1A Exercise of "), F.col("name")))
    return chunking.english_rules(_parts(spark, sf_dir).select("doc_id", "doc_title", F.concat(F.lit("Chapter\n"), F.array_join(lines, "\n")).alias("text")))


def _question_texts(spark, sf_dir):
    lines = F.transform(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int")), lambda i: F.concat(i.cast("string"), F.lit(". 什么是"), F.col("name"), F.lit("？\n答："), F.col("p_type"), F.lit("。")))
    title = F.when(F.col("k") % 10 == 0, F.concat(F.lit("如何办理"), "name")).otherwise(F.col("doc_title"))
    text = F.when(F.col("k") % 10 == 0, F.concat("p_type", F.lit(" 到营业部办理即可"))).otherwise(F.array_join(lines, "\n"))
    return _parts(spark, sf_dir).select("doc_id", title.alias("doc_title"), text.alias("text"))


QUESTIONS_SQL = f"""{PARTS_SQL}, asked AS (
  SELECT doc_id, doc_title, i AS ord, '什么是' || name || '？' AS question, p_type || '。' AS answer FROM (SELECT *, unnest(range(1, k % 3 + 2)) AS i FROM parts WHERE k % 10 <> 0)
  UNION ALL SELECT doc_id, '如何办理' || name, 1, '如何办理' || name, p_type || ' 到营业部办理即可' FROM parts WHERE k % 10 = 0),
qa AS (SELECT {sha_sql("p_", "doc_id", "ord", "question[:40]")} AS parent_id, *, '问：' || question || chr(10) || '答：' || answer AS text FROM asked)"""


@query(f"WITH {QUESTIONS_SQL} SELECT parent_id, doc_id, text, doc_title, '问答' || ord AS clause_id, 'qa_pair' AS chunk_type, ord::integer AS position FROM qa")
def question_parents(spark, sf_dir):
    return chunking.questions(_question_texts(spark, sf_dir))


@query(f"WITH {QUESTIONS_SQL} SELECT {sha_sql('qa1_', 'parent_id', chr(39) + 't1' + chr(39))} AS qa_id, question, answer, 1 AS tier, parent_id, doc_id, 'human' AS mining_method FROM qa WHERE length(question) >= 5 AND length(answer) >= 5")
def written_pairs(spark, sf_dir):
    return mining.written_pairs(chunking.questions(_question_texts(spark, sf_dir)))


FIELDS = ("合约单位", "合约标的", "最小变动价位")


def _facts(spark, sf_dir):
    """Parts are dealt over all cores, as the work on their facts is large beside the few splits that their few bytes give."""
    parts = spread(_parts(spark, sf_dir), "k")
    rows = F.array(*[F.array(F.lit(f), x) for f, x in zip(FIELDS, (F.col("p_size").cast("string"), F.col("name"), F.lit("")))])
    tables = F.array(F.struct(F.lit(2).alias("n_cols"), rows.alias("rows")), F.struct(F.lit(3).alias("n_cols"), rows.alias("rows")))
    return chunking.table_facts(parts.select("doc_id", "doc_title", tables.alias("tables")))


FACTS_SQL = f"""{PARTS_SQL}, facts AS (
  SELECT {sha_sql("p_", "doc_id", "0", "row_no")} AS parent_id, doc_id, p_brand || '的' || field || '：' || value AS text, doc_title, field AS clause_id, 'table_row' AS chunk_type, row_no::integer AS position, p_brand AS subject, value FROM (
    SELECT *, 0 AS row_no, '{FIELDS[0]}' AS field, p_size::varchar AS value FROM parts UNION ALL SELECT *, 1, '{FIELDS[1]}', name FROM parts))"""


@query(f"WITH {FACTS_SQL} SELECT * EXCLUDE (value) FROM facts")
def table_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


@query(f"""
WITH {FACTS_SQL}, forms AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {str(i == 1).lower()})" for i, t in enumerate(mining.TEMPLATES))}) t(form, amount))
SELECT {sha_sql("qa2a_", "parent_id", "form")} AS qa_id, replace(replace(form, '{{s}}', subject), '{{f}}', clause_id) AS question, value AS answer, 2 AS tier, parent_id, doc_id, 'table_template' AS mining_method
FROM facts JOIN forms ON NOT (amount AND clause_id = '{FIELDS[1]}')""")
def template_pairs(spark, sf_dir):
    return mining.template_pairs(_facts(spark, sf_dir))


@query(f"""
WITH {FACTS_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY parent_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY clause_id, subject ORDER BY parent_id) AS m FROM facts) WHERE m = 1)
SELECT {sha_sql("qa2c_", "a.parent_id", "b.parent_id", chr(39) + "cmp" + chr(39))} AS qa_id, a.subject || '与' || b.subject || '的' || a.clause_id || '有什么区别？' AS question,
  a.subject || '的' || a.clause_id || '为' || a.value || '；' || b.subject || '的' || a.clause_id || '为' || b.value || '。' AS answer, 2 AS tier, a.parent_id, a.doc_id, 'cross_venue' AS mining_method
FROM one a JOIN one b ON a.clause_id = b.clause_id AND a.n = 1 AND b.n = 2 WHERE a.value <> b.value""")
def comparison_pairs(spark, sf_dir):
    return mining.comparison_pairs(_facts(spark, sf_dir))


@query(f"""
WITH {QUESTIONS_SQL}, {FACTS_SQL.removeprefix(PARTS_SQL + ", ")}
SELECT 'human' AS mining_method, count(*) AS n, 0::bigint AS paraphrased FROM qa WHERE length(question) >= 5 AND length(answer) >= 5
UNION ALL SELECT 'table_template', sum(CASE WHEN clause_id = '{FIELDS[1]}' THEN 2 ELSE 3 END)::bigint, 0 FROM facts""")
def gold_profile(spark, sf_dir):
    return profile.describe_gold(written_pairs(spark, sf_dir).unionByName(template_pairs(spark, sf_dir)))


@query(f"""
WITH {PARTS_SQL}, l AS (SELECT doc_id, unnest([0, 1, 2, 3, 4, 5]) AS line_no, unnest(['前言 ' || name, '第一章 ' || p_type, '第一节 ' || name, '正文 ' || name, '第二章 ' || p_brand, '正文']) AS line,
  unnest([[]::varchar[], ['第一章 ' || p_type], ['第一章 ' || p_type, '第一节 ' || name], ['第一章 ' || p_type, '第一节 ' || name], ['第二章 ' || p_brand], ['第二章 ' || p_brand]]) AS path FROM parts)
SELECT doc_id, line_no, line, array_to_string(path, ' > ') AS path FROM l""")
def section_paths(spark, sf_dir):
    lines = F.array_join(F.array(F.concat(F.lit("前言 "), "name"), F.concat(F.lit("第一章 "), "p_type"), F.concat(F.lit("第一节 "), "name"), F.concat(F.lit("正文 "), "name"), F.concat(F.lit("第二章 "), "p_brand"), F.lit("正文")), "\n")
    return titles.section_paths(_parts(spark, sf_dir).select("doc_id", lines.alias("text"))).withColumn("path", F.array_join("path", " > "))


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split_regex(text, '\n+')) AS line, generate_subscripts(string_split_regex(text, '\n+'), 1) AS l FROM documents WHERE text IS NOT NULL),
marked AS (SELECT doc_id, l, regexp_replace(regexp_replace(line, '([。；！？!?;])\s*', '\1' || chr(1), 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g') AS m FROM lines),
cut AS (SELECT doc_id, l, unnest(string_split(m, chr(1))) AS s, generate_subscripts(string_split(m, chr(1)), 1) AS p FROM marked)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY l, p) - 1)::integer AS ord, s AS sentence FROM (SELECT doc_id, l, p, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM cut) WHERE s <> ''""")
def sentences(spark, sf_dir):
    parts = tx.sentences(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(parts).alias("ord", "sentence"))


# --- titles, numbers, markers ------------------------------------------------------------------------------------
@query(f"""
WITH {PARTS_SQL}, raw AS (SELECT k, doc_id, '  ' || name || '  ' || p_brand || CASE k % 4 WHEN 0 THEN ' | SGX' WHEN 1 THEN ' - HKEX_Rulebook' WHEN 2 THEN '｜' || p_type ELSE '' END AS raw,
  CASE WHEN k % 5 = 0 THEN p_type || '交易规则' END AS named FROM parts),
clean AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM raw)
SELECT doc_id, coalesce(named, trim(string_split_regex(regexp_replace(t, '( \\| SGX| - HKEX_Rulebook)$', ''), '[|｜]')[1])) AS doc_title FROM clean""")
def resolved_titles(spark, sf_dir):
    ends = F.when(F.col("k") % 4 == 0, " | SGX").when(F.col("k") % 4 == 1, " - HKEX_Rulebook").when(F.col("k") % 4 == 2, F.concat(F.lit("｜"), "p_type")).otherwise("")
    docs = _parts(spark, sf_dir).withColumn("title", F.concat(F.lit("  "), "name", F.lit("  "), "p_brand", ends)).withColumn("notes", F.lit(None).cast("string")).withColumn("pdf_title", F.lit(None).cast("string"))
    named = docs.where("k % 5 = 0").select("doc_id", F.concat("p_type", F.lit("交易规则")).alias("title"))
    return titles.resolved_titles(docs.select("doc_id", "title", "notes", "pdf_title"), named).select("doc_id", "doc_title")


@query(f"""
WITH {PARTS_SQL}, n AS (SELECT k, k % 3999 + 1 AS n FROM parts),
d AS (SELECT *, n // 1000 AS a, n // 100 % 10 AS b, n // 10 % 10 AS c, n % 10 AS e FROM n),
w AS (SELECT *, CASE WHEN a = 0 THEN '零' ELSE substr('{NINE}', a::integer, 1) || '千' END || CASE WHEN b = 0 THEN '零' ELSE substr('{NINE}', b::integer, 1) || '百' END
  || CASE WHEN c = 0 THEN '零' ELSE substr('{NINE}', c::integer, 1) || '十' END || CASE WHEN e = 0 THEN '零' ELSE substr('{NINE}', e::integer, 1) END AS w FROM d)
SELECT k, regexp_replace(regexp_replace(regexp_replace(w, '零+', '零', 'g'), '^零|零$', '', 'g'), '^一十', '十') AS chinese, n::integer AS back,
  repeat('M', a::integer) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][b::integer + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][c::integer + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][e::integer + 1] AS roman,
  chr(((n - 1) % 26 + 97)::integer) AS letter FROM w""")
def list_numbers(spark, sf_dir):
    n = (F.col("k") % 3999 + 1).cast("int")
    chinese = numerals.list_label(n, "chineseCounting")
    return _parts(spark, sf_dir).select("k", chinese.alias("chinese"), tx.chinese_number(chinese).cast("int").alias("back"), numerals.list_label(n, "upperRoman").alias("roman"), numerals.list_label(n, "lowerLetter").alias("letter"))


@query(f"""
WITH {PARTS_SQL} SELECT doc_id, CASE WHEN k % 3 = 0 THEN '上证发〔2020〕' || k % 90 + 1 || '号' END AS doc_no,
  CASE WHEN k % 2 = 0 THEN '2021-0' || k % 9 + 1 || '-05' END AS effective, CASE WHEN k % 5 = 0 THEN '已废止' WHEN k % 5 = 1 THEN '被修订' WHEN k % 3 = 0 THEN '现行有效' ELSE '未知' END AS status,
  2 * length(name) < 50 AS chinese, k % 7 = 0 AS question, '（' || replace(name, ' ', '') || '）' <> '' AS squeezed_ok, '(' || replace(name, ' ', '') || '),' AS squeezed, regexp_replace(p_type || '_' || p_size, '[^a-zA-Z0-9_]+', '_', 'g')[:40] AS slug
FROM parts""")
def document_marks(spark, sf_dir):
    number = F.when(F.col("k") % 3 == 0, F.concat(F.lit("上证发〔 2020 〕 "), (F.col("k") % 90 + 1).cast("string"), F.lit(" 号"))).otherwise("")
    dated = F.when(F.col("k") % 2 == 0, F.concat(F.lit("自2021年"), (F.col("k") % 9 + 1).cast("string"), F.lit("月5日起施行"))).otherwise("")
    text = F.concat(number, F.lit("\n"), dated)
    title = F.concat(F.when(F.col("k") % 5 == 0, "（已废止）").when(F.col("k") % 5 == 1, "（修订版）").otherwise(""), F.when(F.col("k") % 7 == 0, F.concat("name", F.lit("？| SGX"))).otherwise("规则"))
    mixed = F.concat(F.repeat(F.lit("规"), F.lit(15)), F.repeat(F.col("name"), F.lit(2)), F.repeat(F.lit("x"), F.lit(35)))
    odd = F.concat(F.lit("（ "), "name", F.lit("　） ，"))
    rows = _parts(spark, sf_dir).select("doc_id", "k", "p_type", "p_size", text.alias("text"), title.alias("title"), mixed.alias("mixed"), odd.alias("odd"))
    slug = tx.slug(F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")))
    return rows.select("doc_id", tx.document_number(F.col("text")).alias("doc_no"), tx.effective_date(F.col("text")).alias("effective"), tx.effective_status(F.col("title"), F.col("text")).alias("status"), tx.is_chinese(F.col("mixed")).alias("chinese"), tx.is_question_title(F.col("title")).alias("question"), (tx.squeezed(F.col("odd")) != "").alias("squeezed_ok"), tx.squeezed(F.col("odd")).alias("squeezed"), slug.alias("slug"))


@query(f"""
WITH {PARTS_SQL} SELECT doc_id, CASE WHEN k % 3 = 2 THEN '' ELSE name || '?' END AS answer, CASE WHEN k % 3 = 2 OR 8 * length(p_type) < length(name) + 1 THEN p_type ELSE name || '?' END AS rewritten,
  CASE WHEN k % 4 = 0 THEN NULL ELSE name END AS question, CASE WHEN k % 4 = 0 THEN NULL ELSE p_type END AS mined,
  p_brand || '：' || p_size || chr(10) || name || ' | ' || p_type || ' | x' AS rows, name || chr(10) || p_type AS page, [name, p_type, name] AS cells, p_type AS body FROM parts""")
def answers_and_tables(spark, sf_dir):
    """A model's answers, and tables within pages, with what surrounds them taken off."""
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("<think>a\nb</think> "), "name", F.lit("?"))).when(F.col("k") % 3 == 1, F.concat("name", F.lit("?<think>never closed"))).otherwise("<think>all of it")
    reply = F.when(F.col("k") % 4 == 0, "no list here").otherwise(F.concat(F.lit('```json\n[{"question": "'), "name", F.lit('", "answer": "'), "p_type", F.lit('"}]\n```')))
    lines = F.array(F.array("p_brand", F.col("p_size").cast("string")), F.array(F.lit(" "), F.lit(None)), F.array("name", "p_type", F.lit("x")))
    page = F.concat_ws("\n", "name", F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")), "p_type")
    tables = F.array(F.array(F.array("p_brand", F.col("p_size").cast("string"))))
    cells = F.array("name", "name", "p_type", "p_type", "name")
    pairs = tx.json_pairs(F.col("reply"))
    rows = _parts(spark, sf_dir).select("*", raw.alias("raw"), reply.alias("reply"))
    trimmed = tx.trim_boilerplate(F.concat(F.lit("当前位置：首页>>"), "p_type", F.lit(" 版权所有 x")), ("版权所有",), (">>",))
    return rows.select("doc_id", tx.without_thinking(F.col("raw")).alias("answer"), tx.rewritten_or_original(F.col("raw"), F.col("p_type")).alias("rewritten"), F.get(pairs, F.lit(0))["question"].alias("question"), F.get(pairs, F.lit(0))["answer"].alias("mined"), tx.rendered_rows(lines).alias("rows"), tx.without_table_lines(page, tables).alias("page"), tx.without_adjacent_repeats(cells).alias("cells"), trimmed.alias("body"))


@query(f"WITH {PARTS_SQL} SELECT doc_id, '规则' || name || chr(10) || chr(10) || p_brand AS text FROM parts")
def cleaned_extracts(spark, sf_dir):
    """Zero-width marks, gaps between Han characters, page numbers and surplus lines go."""
    raw = F.concat(F.lit("​规 则 "), "name", F.lit("  \r\n\r\n\r\n\r\n - 12 - \r\n"), "p_brand", F.lit(" \n"))
    return _parts(spark, sf_dir).select("doc_id", tx.clean_text(raw).alias("text"))


# --- keyword channel ---------------------------------------------------------------------------------------------
KEYWORD_SQL = f"""
kids AS (SELECT p_partkey AS child_id, p_brand AS doc_id, p_brand || '交易规则' AS doc_title, '第' || substr('{NINE}', p_size % 9 + 1, 1) || '条' AS clause_id, '上证发〔2020〕' || p_partkey % 40 || '号' AS doc_no, p_partkey % 7 = 0 AS repealed FROM part),
asked AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 3 < 2 THEN 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 4 + 1) || '交易规则' END AS named, '第' || substr('{NINE}', (s_suppkey % 9 + 1)::integer, 1) || '条' AS clause_id, CASE WHEN s_suppkey % 2 = 0 THEN '上证发〔2020〕' || s_suppkey % 40 || '号' END AS doc_no FROM supplier),
docs AS (SELECT DISTINCT query_id, doc_id FROM asked JOIN (SELECT DISTINCT doc_id, doc_title FROM kids) t ON contains(doc_title, named) OR contains(named, doc_title)),
byc AS (SELECT a.query_id, k.child_id, d.doc_id IS NOT NULL AS named, EXISTS (SELECT 1 FROM docs x WHERE x.query_id = a.query_id) AS scoped FROM asked a JOIN kids k USING (clause_id) LEFT JOIN docs d ON d.query_id = a.query_id AND d.doc_id = k.doc_id),
hit AS (SELECT query_id, child_id, named AS exact, 0 AS branch FROM (SELECT *, bool_or(named) OVER (PARTITION BY query_id) AS any_named FROM byc) WHERE NOT scoped OR named OR NOT any_named
  UNION ALL SELECT query_id, child_id, true, 1 FROM asked JOIN kids USING (doc_no)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, child_id ORDER BY branch) AS n FROM hit) WHERE n = 1)
"""


def _rule_children(spark, sf_dir):
    status = F.when(F.col("p_partkey") % 7 == 0, tx.REPEALED).when(F.col("p_partkey") % 7 == 1, F.lit(None)).otherwise(tx.UNKNOWN)
    clause = F.concat(F.lit("第"), _digit(F.col("p_size") % 9 + 1), F.lit("条"))
    number = F.concat(F.lit("上证发〔2020〕"), (F.col("p_partkey") % 40).cast("string"), F.lit("号"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child_id"), F.col("p_brand").alias("doc_id"), F.concat("p_brand", F.lit("交易规则")).alias("doc_title"), clause.alias("clause_id"), number.alias("doc_no"), status.alias("effective_status"))


def _rule_questions(spark, sf_dir):
    s = F.col("s_suppkey")
    named = F.when(s % 3 < 2, F.concat(F.lit("《Brand#"), (s % 5 + 1).cast("string"), (s % 4 + 1).cast("string"), F.lit("交易规则》"))).otherwise("")
    number = F.when(s % 2 == 0, F.concat(F.lit("，上证发〔2020〕"), (s % 40).cast("string"), F.lit("号"))).otherwise("")
    return table(spark, sf_dir, "supplier").select(s.alias("query_id"), F.concat(named, F.lit("第"), _digit(s % 9 + 1), F.lit("条"), number).alias("text"))


@query(f"WITH {KEYWORD_SQL} SELECT query_id, child_id, 1.0::double AS score, ord::integer AS ord, exact FROM (SELECT o.*, row_number() OVER (PARTITION BY query_id ORDER BY branch, child_id) AS ord FROM once o JOIN kids USING (child_id) WHERE NOT repealed) WHERE ord <= 20")
def keyword_channel(spark, sf_dir):
    """Clauses within the named rulebooks first, then document numbers; repealed children are set aside before the cut."""
    return keyword.keyword_hits(_rule_questions(spark, sf_dir), _rule_children(spark, sf_dir), None, 20)


RULE_TEXT_SQL = "k.doc_title || ' ' || k.clause_id || ' ' || p_name || ' ' || p_type"
THREE_CHANNELS_SQL = f"""
WITH {KEYWORD_SQL.strip()},
shelf AS (SELECT k.child_id AS doc_id, {RULE_TEXT_SQL} AS text, k.doc_id AS source, repealed FROM kids k JOIN part ON p_partkey = k.child_id),
valid AS (SELECT * FROM shelf WHERE NOT repealed),
wanted AS (SELECT query_id AS item_id, CASE WHEN named IS NULL THEN '' ELSE '《' || named || '》' END || clause_id || coalesce('，' || doc_no, '') AS text FROM asked),
{catalog.BM25_SQL.strip().replace("FROM documents", "FROM shelf").replace("FROM benchmark", "FROM wanted").replace("JOIN dl USING (doc_id)", "JOIN dl USING (doc_id) JOIN valid USING (doc_id)")},
{catalog.DENSE_SQL.strip().replace("JOIN benchmark", "JOIN wanted").replace("JOIN documents", "JOIN valid")},
kw AS (SELECT query_id, child_id, 1.0::double AS score, ord, exact FROM (SELECT o.*, row_number() OVER (PARTITION BY query_id ORDER BY branch, child_id) AS ord FROM once o JOIN kids USING (child_id) WHERE NOT repealed) WHERE ord <= 20),
{catalog.fused_sql(0.3, ("bm25", "dense", "keyword")).strip()},
{catalog.PER_PARENT_SQL.strip().replace("JOIN documents", "JOIN valid")},
said AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM wanted),
rated AS (SELECT p.*, round(12.0 * len(list_intersect(w, regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+'))) / greatest(len(w), 1) - 6, 6) AS second
  FROM per_parent p JOIN said ON item_id = query_id JOIN valid d ON d.doc_id = p.child_id),
final AS (SELECT * FROM (SELECT query_id, child_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, ord) AS n FROM rated) WHERE n <= 5),
pins AS (SELECT * FROM (SELECT p.query_id, p.child_id, p.parent_id, row_number() OVER (PARTITION BY p.query_id ORDER BY kw.ord, p.child_id) AS n FROM per_parent p JOIN kw USING (query_id, child_id)
  WHERE exact AND NOT EXISTS (SELECT 1 FROM final f WHERE f.query_id = p.query_id AND f.child_id = p.child_id)) WHERE n <= 2)
SELECT query_id, child_id, parent_id, pinned, ord::integer AS ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, n) AS ord FROM (
  SELECT *, true AS pinned FROM pins UNION ALL SELECT *, false FROM final)) WHERE ord <= 5"""


@query(THREE_CHANNELS_SQL)
def hybrid_channels(spark, sf_dir):
    """The whole of it with a stored index, all three channels, repealed children set aside before each cut, and exact matches pinned."""
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child_id"), "p_name", "p_type")
    kids = _rule_children(spark, sf_dir).join(texts, "child_id").withColumn("text", F.concat_ws(" ", "doc_title", "clause_id", "p_name", "p_type")).withColumn("parent_id", F.col("doc_id"))
    asked = _rule_questions(spark, sf_dir)
    index = bm25.store(kids, new_path(spark, "text-index"))
    vectors = catalog.vectors(spark, sf_dir, "child_id")
    query_vectors = catalog.vectors(spark, sf_dir, "query_id").join(asked.select("query_id"), "query_id", "left_semi")
    channels = {}
    for name, hits in search.candidates(asked, kids, index, query_vectors, vectors, with_keyword=True).items():
        path = new_path(spark, f"{name}-hits")  # short lists that fusion, ranking and pinning read several times
        hits.write.parquet(path)
        channels[name] = spark.read.parquet(path)
    return search.search(asked, kids, None, channels).select("query_id", "child_id", "parent_id", "pinned", "ord")


@query("SELECT p_partkey AS child_id FROM part WHERE p_partkey % 7 <> 0")
def not_repealed(spark, sf_dir):
    return keyword.not_repealed(_rule_children(spark, sf_dir)).select("child_id")


@query(f"WITH {KEYWORD_SQL} SELECT query_id, [clause_id] AS clauses, CASE WHEN doc_no IS NULL THEN [] ELSE [doc_no] END AS numbers, CASE WHEN named IS NULL THEN [] ELSE [named] END AS titles FROM asked")
def named_references(spark, sf_dir):
    text = F.col("text")
    return _rule_questions(spark, sf_dir).select("query_id", tx.references(text, "clause").alias("clauses"), tx.references(text, "doc_no").alias("numbers"), tx.references(text, "title").alias("titles"))


# --- records, ranks, counts --------------------------------------------------------------------------------------
@query(f"""
WITH {PARTS_SQL} SELECT doc_id, CASE WHEN k % 3 = 0 THEN ',' ELSE p_brand || ',' || p_type END AS titles, CASE WHEN k % 4 = 0 THEN '' ELSE name || '/' || p_brand END AS records,
  nullif(CASE WHEN p_size % 5 < 3 THEN p_size % 5 + 1 ELSE 0 END, 0)::bigint AS place FROM parts""")
def training_records(spark, sf_dir):
    """Titles of all records or of none, negatives beside their metadata, and the place of the right one."""
    record = lambda title: F.struct(F.col("name").alias("text"), title.alias("doc_title"))
    records = F.array(record(F.col("p_brand")), record(F.when(F.col("k") % 3 == 0, "").otherwise(F.col("p_type"))))
    meta = F.array(F.struct(F.col("p_brand").alias("doc_title"), F.lit("").alias("clause_id")))
    metas = F.when(F.col("k") % 4 == 0, F.slice(meta, 1, 0)).otherwise(meta)
    made = mining.records_of(F.array("name"), metas, 2)
    place = evaluation.rank_of(F.array(F.lit(0), F.lit(1), F.lit(2)), (F.col("p_size") % 5).cast("int"))
    rows = _parts(spark, sf_dir).select("*", mining.balanced_metadata(records).alias("balanced"), made.alias("made"))
    return rows.select("doc_id", F.array_join(F.transform("balanced", lambda r: r["doc_title"]), ",").alias("titles"), F.array_join(F.transform("made", lambda r: F.concat(r["text"], F.lit("/"), r["doc_title"])), ",").alias("records"), place.cast("long").alias("place"))


@query("""
WITH h AS (SELECT p_size AS query_id, p_partkey AS child_id, p_brand AS parent_id, p_name AS text, p_retailprice::double AS score, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS ord FROM part),
p AS (SELECT p_brand AS parent_id, max(p_type) AS text FROM part WHERE p_brand < 'Brand#4' GROUP BY p_brand)
SELECT query_id, ord::integer AS index, child_id, coalesce(p.text, h.text) AS text, h.text AS snippet, round(score, 4) AS score, coalesce(nullif(CASE WHEN child_id % 2 = 0 THEN h.parent_id || ' · ' || h.text ELSE '' END, ''), child_id::varchar) AS citation FROM h LEFT JOIN p USING (parent_id)""")
def citations(spark, sf_dir):
    """Hits with the text of their parents where these are known, numbered and named."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("child_id"), F.col("p_brand").alias("parent_id"), F.col("p_name").alias("text"), F.col("p_retailprice").cast("double").alias("score"), "p_type")
    hits = rows.withColumn("ord", F.row_number().over(W.partitionBy("query_id").orderBy("child_id"))).withColumn("scores", F.create_map(F.lit("bm25"), "score")).withColumn("ranks", F.create_map(F.lit("bm25"), "ord"))
    parents = rows.where("parent_id < 'Brand#4'").groupBy("parent_id").agg(F.max("p_type").alias("text"))
    even = F.col("child_id") % 2 == 0
    cited = context.citation(F.when(even, F.col("parent_id")), F.lit(None), F.when(even, F.col("text")), F.lit(""), F.col("child_id"))
    joined = context.attach_parents(hits, parents).withColumn("cited", cited)
    out = context.citations(joined).drop("scores", "ranks")
    return out.join(joined.select("query_id", "child_id", F.col("cited").alias("citation")), ["query_id", "child_id"])


@query("""
WITH c AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations), t AS (SELECT coalesce(next_role, 'none') AS outcome FROM c)
SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY outcome""")
def outcome_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("outcome", F.coalesce(F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("none")))
    return profile.outcomes(rows)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rows_to_remove(spark, sf_dir):
    """Rows of a table whose key the new version lacks."""
    return dedup.to_remove(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def first_turns(spark, sf_dir):
    """One row for each key, the first in order."""
    return dedup.first_by(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], ["turn"])


@query("""
WITH v AS (SELECT vec_id // 10 AS g, vec_id % 10 AS i, embedding::double[] AS v FROM embeddings),
d AS (SELECT a.g, a.i, 1 - list_cosine_similarity(a.v, b.v) AS d FROM v a JOIN v b ON a.g = b.g AND b.i = a.i + 1),
s AS (SELECT g, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY g)
SELECT g, list(i::integer ORDER BY i) AS cuts FROM d JOIN s USING (g) WHERE d > m + s GROUP BY g""")
def breakpoints(spark, sf_dir):
    """Neighbouring vectors that are further apart than a deviation above the mean of their group."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), (F.col("vec_id") % 10).alias("i"), "embedding")
    listed = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "embedding"))).alias("x"))  # ten at most
    near = F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda x, at: 1 - cosine(x["embedding"], F.get(F.col("x"), at + 1)["embedding"]))
    return listed.select("g", chunking.breakpoints(near).alias("cuts")).where("size(cuts) > 0")


# --- pages -------------------------------------------------------------------------------------------------------
@query("""
WITH p AS (SELECT page_id, html, octet_length(encode(html)) AS n, page_id % 4 AS m FROM pages)
SELECT page_id, CASE WHEN m = 0 AND n = 10648 THEN 'blocked' WHEN m = 1 THEN 'content_type' WHEN m = 2 THEN 'magic' WHEN n = 10648 THEN 'blocked' WHEN n < 512 THEN 'too_short' END AS reason, html AS text FROM p""")
def page_checks(spark, sf_dir):
    """What a fetched body is rejected for, and its text decoded from bytes."""
    body = F.encode("html", "UTF-8")
    m = F.col("page_id") % 4
    kind = F.when(m == 1, "application/pdf").when(m == 2, "").otherwise("text/html; charset=utf-8")
    expect = F.when(m == 2, "pdf").otherwise("html")
    return table(spark, sf_dir, "pages").select("page_id", content.rejection(body, kind, expect).alias("reason"), content.decoded(body).alias("text"))


@query(r"""
WITH a AS (SELECT url AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*[\x22\x27][^\x22\x27#][^\x22\x27]*[\x22\x27][^>]*>.*?</a>')) AS anchor, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*[\x22\x27][^\x22\x27#][^\x22\x27]*[\x22\x27][^>]*>.*?</a>'), 1) - 1 AS ord FROM pages),
h AS (SELECT *, regexp_extract(anchor, '(?is)\bhref\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1) AS href, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root,
  regexp_replace(regexp_replace(base, '[?#].*$', ''), '([^/:])/[^/]*$', '\1') AS folder FROM a),
u AS (SELECT base, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href WHEN href LIKE '/%' THEN root || href ELSE folder || '/' || href END AS url,
  trim(regexp_replace(regexp_replace(anchor, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title, ord::integer AS ord FROM h)
SELECT base, url, title, ord FROM (SELECT *, row_number() OVER (PARTITION BY base, url ORDER BY ord) AS n FROM u) WHERE n = 1""")
def page_links(spark, sf_dir):
    return content.links(table(spark, sf_dir, "pages"))


def _plain_sql(x: str) -> str:
    for name, char in html.ENTITIES.items():
        char = "''" if char == "'" else char
        x = f"replace({x}, '{name}', '{char}')"
    return f"regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _paragraphs_sql() -> str:
    body = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in html.DROPPED:
        body = f"regexp_replace({body}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    body = f"regexp_replace({body}, '(?is)<div\\b[^>]*\\b(?:class|id)\\s*=\\s*[\\x22\\x27][^\\x22\\x27]*\\b(?:{html.FURNITURE})\\b[^\\x22\\x27]*[\\x22\\x27][^>]*>[^<]*</div>', ' ', 'g')"
    body = f"regexp_replace({body}, '(?is)<head\\b.*?</head>', ' ', 'g')"
    marks = "(?i)</?(?:p|h[1-6]|li|td|th|tr|div|article|section|ul|ol|table|blockquote|body|html|main)\\b[^>]*>"
    text = _plain_sql("regexp_replace(part, '(?s)<[^>]*>', ' ', 'g')")
    return f"""
WITH b AS (SELECT page_id, string_split(regexp_replace({body}, '{marks}', chr(1), 'g'), chr(1)) AS parts FROM pages WHERE html IS NOT NULL),
t AS (SELECT page_id, n, {text} AS text FROM (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM b))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::integer AS ord, text FROM t WHERE text <> ''"""


@query(_paragraphs_sql())
def html_paragraphs(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", F.posexplode(html.paragraphs(F.col("html"))).alias("ord", "text"))


@query(f"""
WITH {PARTS_SQL} SELECT doc_id, p_brand || chr(10) || name || chr(10) || chr(10) || p_type || '：' || p_size AS text FROM parts""")
def page_tables(spark, sf_dir):
    """Text of a page with its tables as lines below it."""
    page = F.concat(F.lit("<html><body><h1>"), "p_brand", F.lit("</h1><table><tr><td>"), "p_type", F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table><p>"), "name", F.lit("</p></body></html>"))
    return _parts(spark, sf_dir).select("doc_id", html.text_with_tables(page).alias("text"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\p{{Z}}]+|[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\p{{Z}}]+$', '', 'g')"


def _squeezed_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _content_sql() -> str:
    """A given page has an advert and an article: the longer one is its content, each piece of text between tags a line."""
    unescape = "x"
    for name, char in html.ENTITIES.items():
        unescape = f"replace({unescape}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    pieces = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '<!--(?s:.*?)-->|<[^>]*>', chr(1), 'g'), chr(1)), lambda x: {_strip_sql(unescape)}), lambda x: x <> '')"
    chars = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    lines = "list_filter(string_split(body, chr(10)), lambda x: x = '' OR NOT regexp_matches(x, '^[\\s\\-—–]*\\d{1,4}[\\s\\-—–]*$'))"
    invisible = f"regexp_replace(body, '{tx.INVISIBLE}', '', 'g')"
    return f"""
WITH cut AS (SELECT page_id, {pieces("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
    {pieces("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS article, {pieces("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")} AS advert FROM pages),
own AS (SELECT page_id, title[1] AS title, array_to_string(CASE WHEN {chars("advert")} >= {chars("article")} THEN advert ELSE article END, chr(10)) AS body FROM cut),
one AS (SELECT page_id, title, {_squeezed_sql(invisible)} AS body FROM own),
two AS (SELECT page_id, title, {_squeezed_sql(f"array_to_string({lines}, chr(10))")} AS body FROM one),
three AS (SELECT page_id, title, trim(array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(trim(x), '^(?:首页|Home)$|^[\\s>]+$')), chr(10)), ' ' || chr(10)) AS text FROM two)
SELECT page_id, title, text, 'en' AS lang, 0::bigint AS n_tables, CASE WHEN length(text) < 50 THEN 'no selector,short' ELSE 'no selector' END AS warnings FROM three"""


@query(_content_sql())
def html_content(spark, sf_dir):
    """Title and content of each page, cut to the container that holds it."""
    out = page_tree.contents(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id"))
    return out.select("page_id", "title", "text", "lang", F.size("tables").cast("long").alias("n_tables"), F.array_join("warnings", ",").alias("warnings"))


def _product_pages(spark, sf_dir):
    """Pages of two kinds of site: furniture of nested divisions, a content of changing length with a table in a table, and another container."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    size, kind, brand, name = F.col("p_size").cast("string"), F.col("p_type"), F.col("p_brand"), F.col("name")
    body = F.array_join(F.array_repeat(name, (F.col("k") % 5 + 1).cast("int")), " ")
    page = say("<html><head><title>", F.col("doc_title"), "</title></head><body><div id=page>", "<div></div>" * 9,
        "<div class='top-menu'><div><ul><li>", name, "<li>", kind, "</ul></div><div><p>", F.repeat(name, F.lit(9)), "</div></div>",
        "<div class='allZoom wide'><div id=Share-this><div>", kind, "</div></div><h1>", brand, "</h1><p>", body,
        "<table><tr><th>规格<td>", size, "<tr><td>", kind, "<table><tr><td>", brand, "</table><td>z</td></table><form>", body, "</form></div>",
        "<div class=other><p>", kind, "<p>", F.repeat(kind, F.lit(2)), "</div></div></body></html>")
    site = F.when(F.col("k") % 2 == 0, "http://www.sse.com.cn/").otherwise("https://example.org/")
    return _parts(spark, sf_dir).select("doc_id", F.concat(site, "doc_id").alias("url"), page.alias("html"))


@query(f"""
WITH {PARTS_SQL}, own AS (SELECT *, rtrim(repeat(name || ' ', k % 5 + 1)) AS body, p_type || chr(10) || p_type || p_type AS other FROM parts),
sized AS (SELECT *, length(p_brand) + length(body) + 2 + length(p_size::varchar) + length(p_type) + length(p_brand) + 1 AS chars, 3 * length(p_type) AS other_chars FROM own),
picked AS (SELECT *, chars >= other_chars OR (k % 2 = 0 AND chars > 100) AS first FROM sized),
said AS (SELECT doc_id, k, doc_title AS title, first, CASE WHEN first THEN p_brand || chr(10) || body || chr(10) || chr(10) || '规格：' || p_size || chr(10) || p_type || ' ' || p_brand || ' | ' || p_brand || ' | z' || chr(10) || p_brand ELSE other END AS text FROM picked)
SELECT doc_id, title, text, 'en' AS lang, CASE WHEN first THEN 1 ELSE 0 END::bigint AS n_tables, CASE WHEN first THEN 3 END::integer AS n_rows, CASE WHEN first THEN 3 END::integer AS n_cols,
  concat_ws(',', CASE WHEN k % 2 = 1 THEN 'no selector' END, CASE WHEN length(text) < 50 THEN 'short' END) AS warnings FROM said""")
def product_pages(spark, sf_dir):
    """A site's own selector from some length on, else the longest container; furniture goes whole, a table in a table keeps all cells."""
    out = page_tree.contents(spread(_product_pages(spark, sf_dir), "doc_id"))
    first = F.get("tables", F.lit(0))
    return out.select("doc_id", "title", "text", "lang", F.size("tables").cast("long").alias("n_tables"), first["n_rows"].alias("n_rows"), first["n_cols"].alias("n_cols"), F.array_join("warnings", ",").alias("warnings"))



# --- question sets and their summaries ---------------------------------------------------------------------------
def _venue_pairs(spark, sf_dir):
    """Template pairs with the language and venue of their subject: brands of an even number are foreign."""
    brand = F.regexp_extract("question", "Brand#([0-9]+)", 1).try_cast("int")
    return template_pairs(spark, sf_dir).withColumn("lang", F.when(brand % 2 == 0, "en").otherwise("zh")).withColumn("venue", F.concat(F.lit("v"), (brand % 10).cast("string")))


HARD_SQL = f"""{FACTS_SQL}, hard AS (
  SELECT {sha_sql("qa2a_", "parent_id", "form")} AS qa_id, parent_id, replace(replace(form, '{{s}}', subject), '{{f}}', clause_id) AS question, value AS answer
  FROM facts JOIN (SELECT * FROM (VALUES {", ".join(f"('{t}', {str(i == 1).lower()})" for i, t in enumerate(mining.TEMPLATES))}) t(form, amount)) ON NOT (amount AND clause_id = '{FIELDS[1]}')
  WHERE regexp_extract(subject, '[0-9]+')::integer % 10 IN (1, 3, 5)),
drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY qa_id) AS n FROM hard) WHERE n = 1 ORDER BY sha256(qa_id || chr(31) || 'hard'), qa_id LIMIT 40)"""


@query(f"WITH {HARD_SQL} SELECT qa_id, parent_id, question, answer FROM drawn")
def hard_eval(spark, sf_dir):
    """A sample of forty, one question for each parent: the limit is the sample."""
    return mining.hard_eval_set(_venue_pairs(spark, sf_dir), ("v1", "v3", "v5"), 40).select("qa_id", "parent_id", "question", "answer")


@query(f"WITH {HARD_SQL} SELECT qa_id || '_pp' AS qa_id, '请说明：' || question AS question FROM drawn WHERE NOT EXISTS (SELECT 1 FROM facts WHERE contains(facts.text, '请说明：' || drawn.question))")
def reworded_eval(spark, sf_dir):
    """The same with a stand-in for the model, which puts a phrase before the question."""
    said = lambda messages: F.concat(F.lit("<think>x</think>请说明："), F.element_at(messages, -1)["content"])
    corpus = _facts(spark, sf_dir).select("text")
    return generation.reworded(hard_eval(spark, sf_dir), said, corpus).select("qa_id", "question")


@query("""
SELECT doc_id AS parent_id, 'What is ' || doc_id || '?' AS question, CASE doc_id % 3 WHEN 0 THEN 'no such thing' WHEN 1 THEN text[:20] ELSE 'no' END AS answer,
  CASE doc_id % 3 WHEN 0 THEN 'not_in_clause' WHEN 1 THEN 'accepted' ELSE 'too_short' END AS outcome FROM documents
WHERE length(text) BETWEEN 60 AND 1500 AND NOT contains(text[:20], chr(10)) AND NOT contains(text[:20], '"') AND NOT contains(text[:20], chr(92)) AND trim(text[:20]) = text[:20] AND NOT contains(text[:20], '[') AND NOT contains(text[:20], ']')""")
def mined_pairs(spark, sf_dir):
    """Questions of a stand-in for the model, and whether their answers stand in the text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), "text")
    start = F.substring("text", 1, 20)
    docs = docs.where(~start.rlike(r'[\n"\\\[\]]') & (F.trim(start) == start))
    answer = F.when(F.col("parent_id") % 3 == 0, "no such thing").when(F.col("parent_id") % 3 == 1, start).otherwise("no")
    said = lambda messages: F.concat(F.lit('[{"question": "What is '), F.col("parent_id").cast("string"), F.lit('?", "answer": "'), answer, F.lit('"}]'))
    return generation.mined_pairs(docs, said)


@query(f"""
WITH {catalog.QA_SQL.strip()}, x AS ({catalog.SQL["fidelity"].split("x AS (", 1)[1].split("FROM qa)")[0]} FROM qa),
s AS (SELECT CASE WHEN len(nums) > 0 THEN round(len(list_filter(nums, lambda n: contains(a, replace(replace(n, ',', ''), '，', '')))) / len(nums), 6) END AS f,
  round(CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(answer, w))) / len(words) ELSE 0.0 END, 6) AS c FROM x)
SELECT count(*) AS n, count(f) AS fidelity_n, round(avg(f), 4) AS fidelity_mean, round(avg(CASE WHEN f IS NOT NULL THEN (f = 1.0)::integer END), 4) AS fidelity_all_right, round(avg(c), 4) AS coverage_mean, round(avg((c >= 0.6)::integer), 4) AS coverage_enough FROM s""")
def generation_summary(spark, sf_dir):
    return evaluation.generation_summary(catalog.fidelity(spark, sf_dir))


SCORES_SQL = """count(*) AS n, count(fidelity) AS fidelity_n, round(avg(fidelity), 4) AS fidelity_mean, round(avg((fidelity = 1.0)::integer), 4) AS fidelity_all_right,
  round(avg(coverage), 4) AS coverage_mean, round(avg((coverage >= 0.6)::integer), 4) AS coverage_enough"""


@query(f"SELECT turn, {SCORES_SQL} FROM ({catalog.SQL['fidelity']}) GROUP BY turn")
def turn_scores(spark, sf_dir):
    """Answers of conversations by the place of their question: whether later turns are answered worse."""
    return evaluation.generation_summary(catalog.fidelity(spark, sf_dir), by=("turn",))


@query(f"SELECT count(*) AS n, sum(n_neg)::bigint AS negatives, round(avg(n_neg), 4) AS mean, count_if(n_neg < 5) AS short FROM ({catalog.SQL['hard_negatives']})")
def negatives_summary(spark, sf_dir):
    return profile.negatives(catalog.hard_negatives(spark, sf_dir), 5)


@query(r"""
SELECT item_id AS query_id, text, 0::integer AS variant FROM benchmark
UNION ALL SELECT item_id, regexp_replace('Passage on ' || text[:30], '\s+$', ''), 1::integer FROM benchmark WHERE length(text) % 3 <> 0""")
def question_variants(spark, sf_dir):
    """Questions beside the passages of a stand-in for the model, which thinks aloud and sometimes says nothing."""
    asked = catalog.questions(spark, sf_dir)
    content = lambda m: F.get(m, F.lit(1))["content"]
    said = lambda m: F.when(F.char_length(content(m)) % 3 == 0, "<think>nothing comes to mind</think>\n").otherwise(F.concat(F.lit("<think>hm</think>\nPassage on "), F.substring(content(m), 1, 30)))
    return generation.expanded(asked, [said])


@query(r"""
WITH first AS (SELECT a.conv_id, a.turn, a.text, arg_min(b.role || ': ' || b.text, b.turn) AS said FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 8 AND a.turn - 1
  WHERE a.role = 'user' GROUP BY ALL),
made AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(said, '^[^\n]{0,40}'), '^[\x22\x27“”]+', ''), '[\x22\x27“”]+$', '') AS last FROM first)
SELECT conv_id, turn, CASE WHEN said IS NULL OR last = '' OR length(last) > 8 * length(text) THEN text ELSE last END AS text, said IS NOT NULL AS has_history FROM made""")
def standalone_questions(spark, sf_dir):
    """Questions of conversations after a stand-in for the rewriting model, which repeats how the talk began."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "turn", "text")
    said = lambda m: F.concat(F.lit('<think>hm</think>\n"'), F.regexp_extract(F.get(m, F.lit(1))["content"], r"\A[^\n]{0,40}", 0), F.lit('"'))
    out = generation.rewritten(generation.with_history(asked, turns), said)
    return out.select("conv_id", "turn", "text", (F.size("history") > 0).alias("has_history"))


@query(f"""
WITH {catalog.BM25_SQL}, chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS place FROM scored WHERE score > 0 AND child_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src1'))
SELECT query_id, child_id, score, place::integer AS ord FROM chosen WHERE place <= 10""")
def bm25_filtered(spark, sf_dir):
    """Search within one language and without one source: filters apply before the cut to k."""
    kids = catalog.children(spark, sf_dir)
    return bm25.search(bm25.build(kids), catalog.questions(spark, sf_dir), 10, kids.where("lang = 'en' AND parent_id <> 'src1'").select("child_id"))


@query(f"SELECT stage, recall_5, round(100 * (recall_5 - max(CASE WHEN stage = 'bm25' THEN recall_5 END) OVER ()), 2) AS gain FROM ({catalog.SQL['ablation']})")
def ablation_gains(spark, sf_dir):
    return evaluation.against_baseline(catalog.ablation(spark, sf_dir).select("stage", "recall_5"), "bm25")


@query(f"""
WITH {PARTS_SQL}, parents AS (SELECT {sha_sql("p_", "doc_id")} AS parent_id, name AS text, p_brand AS doc_title FROM parts),
pairs AS (SELECT 'qa' || k AS qa_id, {sha_sql("p_", "doc_id")} AS parent_id, p_type || '？' AS question, p_size::varchar AS answer, k % 2 = 0 AS near, [{{'text': p_type, 'doc_title': p_brand}}] AS records FROM parts),
n AS (SELECT greatest(1, floor(count(*) / {mining.DRAWN_FROM}))::bigint AS parts FROM parents),
met AS (SELECT qa_id, o.text, o.doc_title, row_number() OVER (PARTITION BY qa_id ORDER BY sha256(qa_id || '-' || o.parent_id || chr(31) || 'sft'), o.parent_id) AS n
  FROM n, pairs p JOIN parents o ON ('0x' || sha256(p.qa_id || chr(31) || 'sft')[:8])::ubigint % n.parts = ('0x' || sha256(o.parent_id || chr(31) || 'sft')[:8])::ubigint % n.parts AND o.parent_id <> p.parent_id),
others AS (SELECT qa_id, list({{'text': text, 'doc_title': doc_title}} ORDER BY n) AS others FROM met WHERE n <= 4 GROUP BY qa_id),
typed AS (SELECT p.*, {{'text': g.text, 'doc_title': g.doc_title}} AS gold, coalesce(others, []) AS others, ('0x' || sha256(p.qa_id || chr(31) || 'sft')[:8])::ubigint / 4294967296.0 AS r, ('0x' || sha256(p.qa_id || chr(31) || 'sft-place')[:8])::ubigint / 4294967296.0 AS d
  FROM pairs p JOIN parents g USING (parent_id) LEFT JOIN others USING (qa_id)),
kinds AS (SELECT *, CASE WHEN r < 0.15 THEN CASE WHEN near THEN 'refusal_nearmiss' ELSE 'refusal_random' END WHEN r < 0.5 THEN 'distract' ELSE 'answer' END AS sample_type FROM typed),
pools AS (SELECT *, r < 0.15 AS is_refusal, (CASE WHEN near AND sample_type <> 'answer' THEN records ELSE others END)[:CASE WHEN r < 0.15 THEN 4 ELSE 3 END] AS pool FROM kinds),
placed AS (SELECT *, CASE WHEN NOT is_refusal THEN (floor(d * (len(pool) + 1)) + 1)::integer END AS spot FROM pools WHERE NOT is_refusal OR len(pool) > 0)
SELECT qa_id, sample_type, question, array_to_string(list_transform(CASE WHEN is_refusal THEN pool ELSE list_concat(list_concat(list_slice(pool, 1, spot - 1), [gold]), list_slice(pool, spot, 9)) END, lambda x: x.doc_title || '/' || x.text), ';') AS records,
  CASE WHEN sample_type = 'refusal_nearmiss' THEN '{mining.REFUSALS["nearmiss"]}' WHEN is_refusal THEN '{mining.REFUSALS["random"]}' ELSE answer || '[' || spot || ']' END AS answer, is_refusal, spot AS gold_citation FROM placed""")
def training_samples(spark, sf_dir):
    """Refusals, distractions and answers over hard negatives and random parents, in one plan."""
    rows = _parts(spark, sf_dir)
    parent = tx.stable_id("p_", F.col("doc_id"))
    parents = rows.select(parent.alias("parent_id"), F.col("name").alias("text"), F.col("p_brand").alias("doc_title"))
    qa = F.concat(F.lit("qa"), F.col("k").cast("string"))
    pairs = rows.select(qa.alias("qa_id"), parent.alias("parent_id"), F.concat("p_type", F.lit("？")).alias("question"), F.col("p_size").cast("string").alias("answer"))
    negatives = rows.where("k % 2 = 0").select(qa.alias("qa_id"), F.array(F.struct(F.col("p_type").alias("text"), F.col("p_brand").alias("doc_title"))).alias("records"))
    out = mining.training_samples(pairs, parents, negatives)
    return out.withColumn("records", F.array_join(F.transform("records", lambda x: F.concat(x["doc_title"], F.lit("/"), x["text"])), ";"))
