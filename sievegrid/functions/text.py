"""Text functions: each takes columns and gives a column, without Python on the executors.

Patterns carry ``(?U)`` where Unicode digits and blanks count, as they do in CJK texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns of the documents' conventions.
REPEALED, SUPERSEDED, ACTIVE, UNKNOWN = "已废止", "被修订", "现行有效", "未知"
REPEALED_MARKERS = ("已废止", "已作废", "废止", "失效")
SUPERSEDED_MARKERS = ("已修订", "被修订", "修订版")
DOC_NO = r"(?U)(?:[一-鿿]{2,8}\s*)?[〔\[（(]\s*(?:19|20)\d{2}\s*[〕\]）)]\s*第?\s*\d+\s*号"
EFFECTIVE = r"(?U)自\s*((?:19|20)\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*起(?:施行|实施|执行|生效)"
INVISIBLE = "[​-‏‪-‮﻿­]"
HAN = "[一-鿿]"
QUESTION_WORDS = ("如何", "怎么", "怎样", "是否", "能否", "可否", "什么", "哪些", "为何", "为什么")
FULL_WIDTH, HALF_WIDTH = "（）［］｛｝：；，。％－＋　", "()[]{}:;,.%-+ "
SENTENCE_BREAK = r"(?<=[。；！？!?;])\s*|(?<=[.!?])\s+(?=[A-Z])"
REFERENCES = {"clause": r"(?U)第[一二三四五六七八九十百千零〇两\d]{1,10}条", "doc_no": r"(?U)[一-鿿]{2,8}[〔\[（(]\s*(?:19|20)\d{2}\s*[〕\]）)]\s*第?\s*\d+\s*号", "code": r"(?U)\b\d{6}\b|\b[A-Z]{2,3}\d{3,4}\b", "title": "《([^》]{4,60})》"}


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Trims all Unicode blanks, not only the ASCII space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """Content-derived key: the same parts give the same key on every run; null parts count as empty."""
    joined = F.concat_ws("\x1f", *[text_or_empty(p.cast("string")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined.cast("binary"), 256), 1, length))


def close_cjk_gaps(x: Column) -> Column:
    """Removes blanks that extraction put between Han characters and their neighbours."""
    for left, right in (("[0-9A-Za-z%]", HAN), (HAN, "[0-9A-Za-z]"), (HAN, HAN)):
        x = F.regexp_replace(x, f"(?<={left})[ \t]+(?={right})", "")
    return x


def drop_page_numbers(x: Column, furniture: int = 0) -> Column:
    """Drops lines of a page number alone, and optionally lines at either end of the text."""
    lines = F.split(x, "\n", -1)
    if furniture:
        lines = F.slice(lines, F.lit(furniture + 1), F.greatest(F.size(lines) - 2 * furniture, F.lit(0)))
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(r"^(?U)[\s\-—–]*\d{1,4}[\s\-—–]*$") | (line == "")), "\n")


def normal_blanks(x: Column) -> Column:
    """Unix line ends, no blanks before them, at most one empty line, none at the ends."""
    x = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "(?m)[ \t]+$", "")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def clean_text(x: Column, cjk: bool = True) -> Column:
    x = drop_page_numbers(normal_blanks(F.regexp_replace(text_or_empty(x), INVISIBLE, "")))
    return normal_blanks(close_cjk_gaps(x) if cjk else x)


def is_chinese(x: Column, share: float = 0.15) -> Column:
    head = F.substring(text_or_empty(x), 1, 4000)
    return (F.char_length(F.regexp_replace(head, "[^一-鿿]", "")) / F.greatest(F.char_length(head), F.lit(1))) >= share


def document_number(x: Column) -> Column:
    found = F.regexp_extract(F.substring(text_or_empty(x), 1, 3000), DOC_NO, 0)
    return F.nullif(F.regexp_replace(found, r"(?U)\s+", ""), F.lit(""))


def effective_date(x: Column) -> Column:
    year, month, day = (F.regexp_extract(text_or_empty(x), EFFECTIVE, i) for i in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def effective_status(title: Column, x: Column) -> Column:
    seen = F.concat(text_or_empty(title), F.lit("\n"), F.substring(text_or_empty(x), 1, 1500))
    return (
        F.when(seen.rlike("|".join(REPEALED_MARKERS)), REPEALED)
        .when(seen.rlike("|".join(SUPERSEDED_MARKERS)), SUPERSEDED)
        .when(document_number(seen).isNotNull(), ACTIVE)
        .otherwise(UNKNOWN)
    )


def squeezed(x: Column) -> Column:
    """Without any blank and with half-width punctuation, for comparing texts."""
    return F.translate(F.regexp_replace(text_or_empty(x), r"(?U)\s+", ""), FULL_WIDTH, HALF_WIDTH)


def without_blanks(x: Column) -> Column:
    return F.regexp_replace(text_or_empty(x), r"(?U)\s+", "")


def slug(x: Column, longest: int = 40) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(text_or_empty(x), r"(?U)[^\w一-鿿-]+", "_"), "^_+|_+$", ""), 1, longest)
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("untitled"))


def host_of(url: Column) -> Column:
    """Host in lower case, with its port and without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


WORD = r"[\p{L}\p{N}]+"


def words(x: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text_or_empty(x)), F.lit(WORD), F.lit(0))


def word_count(x: Column) -> Column:
    """The size of ``words`` without building them."""
    return F.regexp_count(F.lower(text_or_empty(x)), F.lit(WORD))


def sentences(x: Column) -> Column:
    """Lines, then sentences that keep their end mark; nothing is lost but blanks at the joints."""
    lines = F.transform(F.split(text_or_empty(x), "\n+", -1), strip)
    return F.filter(F.flatten(F.transform(lines, lambda line: F.transform(F.split(line, SENTENCE_BREAK, -1), strip))), lambda s: s != "")


def cjk_joined(parts: Column) -> Column:
    head = F.substring(F.array_join(parts, ""), 1, 200)
    return F.char_length(F.regexp_replace(head, "[^一-鿿]", "")) / F.greatest(F.char_length(head), F.lit(1)) > 0.15


def references(query: Column, kind: str) -> Column:
    """What a question names outright: clauses, document numbers, contract codes or titles."""
    return F.regexp_extract_all(text_or_empty(query), F.lit(REFERENCES[kind]), F.lit(1 if kind == "title" else 0))


def is_question_title(title: Column) -> Column:
    head = strip(F.split(text_or_empty(title), "[|｜]", -1)[0])
    return (F.char_length(head) >= 6) & (head.rlike("[？?]$") | head.rlike("|".join(QUESTION_WORDS)))


def looks_like_table_of_contents(body: Column) -> Column:
    return (F.char_length(body) < 25) & ~body.rlike("[。；！？.;]$")


def trim_boilerplate(x: Column, tail: tuple[str, ...], lead: tuple[str, ...], lead_within: int = 200) -> Column:
    """Cuts at the first tail marker, and after the last lead marker if that stands near the top."""
    x = text_or_empty(x)
    ends = [F.when(F.instr(x, m) > 0, F.instr(x, m)) for m in tail]
    end = ends[0] if len(ends) == 1 else F.least(*ends)
    x = F.when(end.isNotNull(), F.substring(x, F.lit(1), end - 1)).otherwise(x)
    starts = []
    for marker in lead:
        parts = F.split(x, "\\Q" + marker + "\\E", -1)
        last = F.char_length(x) - F.char_length(F.element_at(parts, -1)) - len(marker)
        starts.append(F.when((F.size(parts) > 1) & (last < lead_within), last + len(marker)).otherwise(0))
    cut = starts[0] if len(starts) == 1 else F.greatest(*starts)
    return strip(F.substring(x, cut + 1, F.char_length(x)))


def without_thinking(x: Column) -> Column:
    """Drops reasoning between tags; an opened and never closed one leaves what stood before it."""
    return strip(F.regexp_replace(F.regexp_replace(text_or_empty(x), "(?s)<think>.*?</think>", ""), "(?s)<think>.*$", ""))


def rendered_rows(rows: Column) -> Column:
    """A table as lines: two filled cells as ``field：value``, others joined by a bar."""

    def line(row: Column) -> Column:
        cells = F.filter(F.transform(row, lambda c: strip(text_or_empty(c))), lambda c: c != "")
        return F.when(F.size(cells) == 2, F.array_join(cells, "：")).otherwise(F.array_join(cells, " | "))

    return F.array_join(F.filter(F.transform(rows, line), lambda x: x != ""), "\n")


def without_table_lines(page: Column, tables: Column) -> Column:
    """Drops the lines of a page that its tables hold already; blanks don't matter."""
    blobs = F.transform(tables, lambda t: without_blanks(F.array_join(F.flatten(t), "")))
    kept = F.filter(F.split(text_or_empty(page), "\n", -1), lambda line: (without_blanks(line) == "") | ~F.exists(blobs, lambda b: F.contains(b, without_blanks(line))))
    return F.array_join(kept, "\n")


def without_adjacent_repeats(cells: Column) -> Column:
    """Merged cells come once."""
    return F.filter(cells, lambda c, i: (i == 0) | ~c.eqNullSafe(F.get(cells, i - 1)))


def history_lines(history: Column, turns: int = 4, longest: int = 200) -> Column:
    """The last turns of (role, text) as lines; long answers are cut with an ellipsis."""
    last = F.slice(history, F.greatest(F.size(history) - 2 * turns + 1, F.lit(1)), 2 * turns)
    cut = F.transform(last, lambda m: F.concat(m["role"], F.lit(": "), F.when((m["role"] == "assistant") & (F.char_length(m["text"]) > longest), F.concat(F.substring(m["text"], 1, longest), F.lit("…"))).otherwise(text_or_empty(m["text"]))))
    return F.when(F.coalesce(F.size(history), F.lit(0)) < 1, "（无）").otherwise(F.array_join(cut, "\n"))


def rewritten_or_original(raw: Column, question: Column, factor: int = 8) -> Column:
    """The last line of a rewriter's answer; the question itself where that is empty or far too long."""
    lines = F.filter(F.transform(F.split(without_thinking(raw), "\n", -1), strip), lambda x: x != "")
    last = F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), "^[\"'“”]+|[\"'“”]+$", "")
    return F.when((last == "") | (F.char_length(last) > factor * F.char_length(question)), question).otherwise(last)


def json_pairs(raw: Column) -> Column:
    """Question and answer pairs of a model's answer, with or without a code fence; null where it isn't a list."""
    text = F.regexp_replace(text_or_empty(raw), "```(?:json)?", "")
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.from_json(F.nullif(body, F.lit("")), "array<struct<question string, answer string>>")


def chinese_number(x: Column) -> Column:
    """Value of a Chinese numeral such as 一百零三, null for anything else; digits are taken as they are."""
    digits = "零一二三四五六七八九"
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"), F.lit(True).alias("sound"))

    def step(s: Column, c: Column) -> Column:
        digit = F.instr(F.lit(digits), c) - 1
        unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000)
        plain = F.when(c == "两", 2).when(c == "〇", 0).when(digit >= 0, digit)
        added = s["total"] + F.when((s["digit"] == 0) & (unit == 10) & (s["total"] == 0), 1).otherwise(s["digit"]) * F.coalesce(unit, F.lit(0))
        return F.struct(
            F.when(unit.isNotNull(), added).otherwise(s["total"]).alias("total"),
            F.when(unit.isNotNull(), 0).otherwise(F.coalesce(plain, F.lit(0))).cast("int").alias("digit"),
            (s["sound"] & (unit.isNotNull() | plain.isNotNull())).alias("sound"),
        )

    chars = F.filter(F.split(text_or_empty(x), ""), lambda c: c != "")
    value = F.aggregate(chars, start, step, lambda s: F.when(s["sound"], s["total"] + s["digit"]))
    return F.when(x.rlike(r"^[0-9]{1,9}$"), x.cast("int")).when(text_or_empty(x) != "", value)
