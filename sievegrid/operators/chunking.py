"""Parents and children of documents: clauses, numbered rules, table facts, question pairs, prose, and sentence packs.

Splitting is done by built-in regular expressions and array functions; packing sentences by size is a running
fold over one document's sentences, expressed as an aggregate over its array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import cjk_joined, is_question_title, looks_like_table_of_contents, sentences, stable_id, strip, text_or_empty

# How clauses, chapters, rules and numbered questions begin.
CLAUSE = r"(?U)第[一二三四五六七八九十百千零〇两\d]{1,10}条(?![款项目])"
CHAPTER = r"(?Um)^[^\S\n]*第[一二三四五六七八九十百千零〇\d]{1,10}[章节编部分][^\n]{0,41}$"
RULE = r"(?m)^[ \t]*(?:Rule\s+)?\d+(?:\.\d+){1,4}[A-Z]?[ \t]+(?=[A-Z(])"
NUMBERED_QUESTION = r"(?Um)^\s*\d{1,3}\s*[.．、][^\n]{2,200}[？?]"
FORM_WORDS = "合约基本条款|合约条款|基本条款|附件"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row: inside a function over an array an expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces_at(text: Column, start: str) -> Column:
    """(ord, body) from each match of ``start`` to the next; what stands before the first match is left out."""
    flags = start[: start.index(")") + 1] if start.startswith("(?") and start[2] in "Umds" else ""
    parts = F.split(text_or_empty(text), f"{flags}(?={start[len(flags):]})", -1)
    begins = F.filter(parts, lambda p: p.rlike(f"{flags}\\A(?:{start[len(flags):]})"))
    return F.transform(begins, lambda p, i: F.struct(i.alias("ord"), strip(p).alias("body")))


def _made(docs: DataFrame, pieces: Column) -> DataFrame:
    """A row for each piece (key, body, clause_id, kind, position); the key tells a piece of its document from the others."""
    rows = docs.select("doc_id", "doc_title", F.explode(pieces).alias("piece"))
    return rows.select(F.concat(F.lit("p_"), F.substring(F.sha2(F.concat(text_or_empty(F.col("doc_id").cast("string")), F.lit("\x1f"), "piece.key").cast("binary"), 256), 1, 16)).alias("parent_id"), "doc_id", F.col("piece.body").alias("text"), "doc_title", F.col("piece.clause_id").alias("clause_id"), F.col("piece.kind").alias("chunk_type"), F.col("piece.position").alias("position"))


def _piece(body: Column, clause: Column, kind: str, position: Column, *key: Column) -> Column:
    joined = F.concat_ws("\x1f", *[text_or_empty(k.cast("string")) for k in key])
    return F.struct(joined.alias("key"), body.alias("body"), clause.alias("clause_id"), F.lit(kind).alias("kind"), position.cast("int").alias("position"))


def _at_least_three(pieces: Column, keep: Callable[[Column], Column]) -> Column:
    return once(pieces, lambda own: F.when(F.size(own) >= 3, keep(own)))


def clause_pieces(text: Column) -> Column:
    """Chinese clauses of a text with three at least; lines of a table of contents and scraps go."""
    kept = lambda found: F.filter(found, lambda p: ~looks_like_table_of_contents(p["body"]) & (F.char_length(p["body"]) >= 10))
    number = lambda p: F.regexp_extract(p["body"], CLAUSE, 0)
    made = lambda found: F.transform(kept(found), lambda p: _piece(p["body"], number(p), "clause", p["ord"], number(p), p["ord"]))
    return F.when(F.contains(text, F.lit("条")), _at_least_three(pieces_at(text, CLAUSE), made))


def clauses(docs: DataFrame) -> DataFrame:
    return _made(docs, clause_pieces(F.col("text")))


def rule_pieces(text: Column) -> Column:
    number = lambda p: F.regexp_extract(p["body"], r"^\s*(?:Rule\s+)?(\d+(?:\.\d+){1,4}[A-Z]?)", 1)
    made = lambda found: F.transform(F.filter(found, lambda p: F.char_length(p["body"]) >= 25), lambda p: _piece(p["body"], number(p), "clause", p["ord"], number(p), p["ord"]))
    return _at_least_three(pieces_at(text, RULE), made)


def english_rules(docs: DataFrame) -> DataFrame:
    return _made(docs, rule_pieces(F.col("text")))


def table_facts(docs: DataFrame) -> DataFrame:
    """One parent per row of a two-column table: ``subject的field：value``."""
    subject = F.regexp_replace(F.regexp_replace(text_or_empty(F.col("doc_title")), FORM_WORDS, ""), "^[ \\-—·|]+|[ \\-—·|]+$", "")
    rows = docs.select("doc_id", "doc_title", subject.alias("subject"), F.posexplode("tables").alias("table_no", "table")).where("table.n_cols = 2")
    rows = rows.select("doc_id", "doc_title", "subject", "table_no", F.posexplode("table.rows").alias("row_no", "cells"))
    cells = F.filter(F.transform("cells", lambda c: strip(text_or_empty(c))), lambda c: c != "")
    rows = rows.withColumn("cells", cells).where("size(cells) = 2 AND char_length(get(cells, 0)) <= 30")
    field, value = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))  # filters above may be asked before the one on the size
    text = F.concat(F.when(F.col("subject") != "", F.concat("subject", F.lit("的"))).otherwise(""), field, F.lit("："), value)
    made = stable_id("p_", F.col("doc_id"), F.col("table_no"), F.col("row_no"))
    return rows.select(made.alias("parent_id"), "doc_id", text.alias("text"), "doc_title", field.alias("clause_id"), F.lit("table_row").alias("chunk_type"), F.col("row_no").alias("position"), "subject")


def question_pairs(text: Column) -> Column:
    """(ord, question, answer) of numbered questions; a leading answer mark goes once."""
    found = pieces_at(text, NUMBERED_QUESTION)

    def split(p: Column) -> Column:
        head = F.regexp_extract(p["body"], r"(?U)\A\s*\d{1,3}\s*[.．、]\s*([^\n]{2,200}?[？?])", 1)
        answer = F.regexp_replace(F.regexp_replace(p["body"], r"(?U)\A\s*\d{1,3}\s*[.．、]\s*[^\n]{2,200}?[？?]", ""), r"(?U)\A\s*答\s*[：:]", "")
        return F.struct((p["ord"] + 1).alias("ord"), strip(head).alias("question"), strip(answer).alias("answer"))

    return F.filter(F.transform(found, split), lambda p: (p["question"] != "") & (p["answer"] != ""))


def question_pieces(text: Column, title: Column) -> Column:
    """Numbered pairs of a document, else its title as the question and its text as the answer."""
    asks = F.contains(text_or_empty(text), F.lit("?")) | F.contains(text_or_empty(text), F.lit("？"))  # others have no numbered question
    whole = strip(text_or_empty(text))
    alone = F.array(F.struct(F.lit(1).alias("ord"), strip(title).alias("question"), whole.alias("answer")))
    chosen = lambda pairs: F.when(F.size(pairs) > 0, pairs).when(is_question_title(title) & F.char_length(whole).between(10, 3000), alone)
    body = lambda p: F.concat(F.lit("问："), p["question"], F.lit("\n答："), p["answer"])
    return F.transform(once(F.when(asks, question_pairs(text)), chosen), lambda p: _piece(body(p), F.concat(F.lit("问答"), p["ord"].cast("string")), "qa_pair", p["ord"], p["ord"], F.substring(p["question"], 1, 40)))


def questions(docs: DataFrame) -> DataFrame:
    return _made(docs, question_pieces(F.col("text"), F.col("doc_title")))


def _fold(parts: Column, joined, most: int) -> Column:
    """Adds parts to the open piece while it stays within ``most`` characters; a longer part stands alone."""
    start = F.struct(F.expr("cast(array() AS array<string>)").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        both = joined(s["open"], p)
        fits = F.char_length(both) <= most
        done = F.when(fits | (s["open"] == ""), s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.struct(done.alias("done"), F.when(fits, both).otherwise(p).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def packed_paragraphs(text: Column, most: int = 4000) -> Column:
    """Paragraphs packed up to ``most`` characters; longer ones are cut between sentences first."""
    paragraphs = F.split(text_or_empty(text), r"(?U)\n\s*\n", -1)
    cut = F.flatten(F.transform(paragraphs, lambda p: F.when(F.char_length(p) <= most, F.array(p)).otherwise(_fold(F.split(p, "(?<=[。；！？!?;])", -1), lambda a, b: F.concat(a, b), most))))
    return _fold(cut, lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b)), most)


def prose_pieces(text: Column, most: int = 4000, least: int = 30) -> Column:
    """Chapters, or the whole text, in pieces of at most ``most`` characters."""
    parts = F.filter(F.split(text_or_empty(text), f"(?Um)(?={CHAPTER[5:]})", -1), lambda p: strip(p) != "")
    label = lambda segment: F.nullif(strip(F.regexp_extract(segment, f"(?Um)\\A{CHAPTER[5:]}", 0)), F.lit(""))
    packs = F.flatten(F.transform(parts, lambda segment, part: F.transform(packed_paragraphs(segment, most), lambda body, ord_: F.struct(part.alias("part"), label(segment).alias("label"), ord_.alias("ord"), strip(body).alias("body")))))
    return F.transform(F.filter(packs, lambda p: F.char_length(p["body"]) >= least), lambda p: _piece(p["body"], p["label"], "prose", p["ord"], p["part"], p["ord"], F.substring(p["body"], 1, 60)))


def prose(docs: DataFrame, most: int = 4000, least: int = 30) -> DataFrame:
    return _made(docs, prose_pieces(F.col("text"), most, least))


def parents(docs: DataFrame) -> DataFrame:
    """Table facts, and for the body the first way that gives anything: clauses, questions, rules, prose.

    The way is chosen in the document's own row, and a later one is only tried where those before it gave nothing.
    """
    text = F.col("text")
    ways = [clause_pieces(text), question_pieces(text, F.col("doc_title")), rule_pieces(text)]
    body = _made(docs, F.coalesce(*[once(w, lambda own: F.when(F.size(own) > 0, own)) for w in ways], prose_pieces(text)))
    return body.unionByName(table_facts(docs).drop("subject")) if "tables" in docs.columns else body


def breakpoints(distances: Column, z: float = 1.0) -> Column:
    """Positions whose distance is above mean + z times the population deviation."""

    def above(limit: Column, own: Column) -> Column:
        return F.filter(F.transform(own, lambda d, i: F.when(d > limit, i)), lambda x: x.isNotNull())

    def cut(own: Column) -> Column:
        n = F.greatest(F.size(own), F.lit(1))
        mean = F.aggregate(own, F.lit(0.0), lambda s, d: s + d) / n
        spread = lambda m: F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, d: s + d * d) / n - m * m)
        return once(once(mean, lambda m: m + z * F.coalesce(F.nanvl(spread(m), F.lit(0.0)), F.lit(0.0))), lambda limit: above(limit, own))

    return once(distances, cut)


def packed_sentences(parts: Column, cuts: Column, target: int = 300, most: int = 512, least: int = 80, overlap: int = 1) -> Column:
    """Sentence packs: closed at a breakpoint from half the target on, or at the target; packs share ``overlap`` sentences.

    Packs over ``most`` are cut between sentences, and those under ``least`` join the one before.
    """
    strings = "cast(array() AS array<string>)"
    numbered = once(cuts, lambda own: F.transform(parts, lambda s, i: F.struct(s.alias("s"), F.array_contains(own, i).alias("cut"))))
    start = F.struct(F.expr("cast(array() AS array<array<string>>)").alias("done"), F.expr(strings).alias("open"), F.lit(0).alias("fresh"))

    def size(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + F.char_length(x))

    def step(st: Column, x: Column) -> Column:
        grown = F.array_append(st["open"], x["s"])
        length = size(grown)
        close = (length >= target) | (x["cut"] & (length >= target * 0.5))
        tail = F.slice(grown, F.greatest(F.size(grown) - overlap + 1, F.lit(1)), overlap) if overlap else F.expr(strings)
        return F.struct(F.when(close, F.array_append(st["done"], grown)).otherwise(st["done"]).alias("done"), F.when(close, tail).otherwise(grown).alias("open"), F.when(close, 0).otherwise(st["fresh"] + 1).alias("fresh"))

    groups = F.aggregate(numbered, start, step, lambda st: F.when((st["fresh"] > 0) | (F.size(st["done"]) == 0), F.array_append(st["done"], st["open"])).otherwise(st["done"]))

    def glue(a: Column, b: Column) -> Column:
        return F.when(a == "", b).when(cjk_joined(F.array(a, b)), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    def written(g: Column) -> Column:
        text = F.when(cjk_joined(g), F.array_join(g, "")).otherwise(F.array_join(g, " "))
        return F.when(F.char_length(text) <= most, F.array(text)).otherwise(_fold(g, glue, most))

    flat = F.filter(F.flatten(F.transform(groups, written)), lambda t: strip(t) != "")
    merged = F.aggregate(
        flat,
        F.expr(strings),
        lambda out, t: F.when((F.size(out) > 0) & (F.char_length(t) < least), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.concat(F.element_at(out, -1), F.lit("\n"), t))).otherwise(F.array_append(out, t)),
    )
    return merged


def children(parents_: DataFrame, distances: Column | None = None, target: int = 300, most: int = 512, least: int = 80, overlap: int = 1, z: float = 1.0) -> DataFrame:
    """(child_id, parent_id, doc_id, text, position): short parents and table facts stay whole, others are packed.

    ``distances`` between neighbouring sentences, of a model, give breakpoints; without them length alone decides.
    """
    parts = sentences(F.col("text"))
    cuts = breakpoints(distances, z) if distances is not None else F.expr("cast(array() AS array<int>)")
    step = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(most))
    sliced = F.transform(step, lambda i: F.substring(F.col("text"), i + 1, F.lit(most)))
    whole = (F.col("chunk_type") == "table_row") | (F.char_length("text") <= most)
    cut = F.when(whole, F.array(F.col("text"))).when(F.size(parts) <= 1, sliced).otherwise(packed_sentences(parts, cuts, target, most, least, overlap))
    rows = parents_.select("parent_id", "doc_id", F.posexplode(cut).alias("position", "text")).where(strip(F.col("text")) != "")
    return rows.select(stable_id("c_", F.col("parent_id"), F.col("position")).alias("child_id"), "parent_id", "doc_id", "text", "position")
