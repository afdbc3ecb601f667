"""Question and answer sets from parents, leak checks, hard negatives and training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.functions.text import squeezed, stable_id, strip, text_or_empty, without_blanks
from sievegrid.operators.containment import containing
from sievegrid.operators.dedup import first_by

# Wording of generated questions and answers.
TEMPLATES = ("{s}的{f}是什么？", "{s}的{f}是多少？", "请问{s}的{f}如何规定？")
WORDED_FIELDS = ("合约标的", "合约类型", "行权方式", "交割方式", "买卖类型", "合约到期月份")
REFUSALS = {"nearmiss": "给出的条款没有回答这个问题。", "random": "给出的内容与问题无关。"}


def roll(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key and a seed, the same on every run and in any SQL with sha256."""
    digest = F.sha2(F.concat_ws("\x1f", key.cast("string"), F.lit(seed)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def seeded_order(key: Column, seed: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", key.cast("string"), F.lit(seed)).cast("binary"), 256)


def written_pairs(parents: DataFrame) -> DataFrame:
    """Pairs that people wrote: the question and answer of each pair parent."""
    pattern = r"(?s)\A问：(.+?)\n答：(.+)"
    rows = parents.where("chunk_type = 'qa_pair'")
    rows = rows.select("parent_id", "doc_id", strip(F.regexp_extract("text", pattern, 1)).alias("question"), strip(F.regexp_extract("text", pattern, 2)).alias("answer"))
    rows = rows.where("char_length(question) >= 5 AND char_length(answer) >= 5")
    return rows.select(stable_id("qa1_", F.col("parent_id"), F.lit("t1")).alias("qa_id"), "question", "answer", F.lit(1).alias("tier"), "parent_id", "doc_id", F.lit("human").alias("mining_method"))


def _facts(parents: DataFrame) -> DataFrame:
    """(parent_id, doc_id, subject, field, value) of table facts."""
    value = strip(F.regexp_extract("text", "(?s)：(.*)", 1))
    return parents.where("chunk_type = 'table_row'").select("parent_id", "doc_id", strip(text_or_empty(F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.col("doc_title")))).alias("subject"), strip(F.col("clause_id")).alias("field"), value.alias("value"))


def template_pairs(parents: DataFrame) -> DataFrame:
    """Questions about each table fact; fields of words skip the wording for amounts."""
    facts = _facts(parents).where("subject <> '' AND field <> '' AND value <> '' AND char_length(value) <= 400")
    every, worded = (F.array(*[F.lit(TEMPLATES[i]) for i in at]) for at in ((0, 1, 2), (0, 2)))
    rows = facts.withColumn("form", F.explode(F.when(F.col("field").isin(*WORDED_FIELDS), worded).otherwise(every)))
    question = F.replace(F.replace("form", F.lit("{s}"), F.col("subject")), F.lit("{f}"), F.col("field"))
    return rows.select(stable_id("qa2a_", F.col("parent_id"), F.col("form")).alias("qa_id"), question.alias("question"), F.col("value").alias("answer"), F.lit(2).alias("tier"), "parent_id", "doc_id", F.lit("table_template").alias("mining_method"))


def first_two(rows: DataFrame, group: str, subject: str, order: list[str]) -> DataFrame:
    """The first two distinct subjects of each group side by side, as structs a and b."""
    once = first_by(rows, [group, subject], order)
    numbered = once.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_n <= 2")
    columns = [c for c in rows.columns if c != group]
    picked = numbered.groupBy(group).agg(*[F.max(F.when(F.col("_n") == i, F.struct(*columns))).alias(name) for i, name in ((1, "a"), (2, "b"))])
    return picked.where("b IS NOT NULL")


def comparison_pairs(parents: DataFrame, most: int = 300) -> DataFrame:
    """One question per field on how the first two subjects differ in it, ``most`` in all by field."""
    pairs = first_two(_facts(parents).where("subject <> '' AND field <> ''"), "field", "subject", ["parent_id"])
    pairs = pairs.where("a.value <> b.value AND char_length(a.value) <= 200 AND char_length(b.value) <= 200").orderBy("field").limit(most)
    question = F.concat("a.subject", F.lit("与"), "b.subject", F.lit("的"), "field", F.lit("有什么区别？"))
    answer = F.concat("a.subject", F.lit("的"), "field", F.lit("为"), "a.value", F.lit("；"), "b.subject", F.lit("的"), "field", F.lit("为"), "b.value", F.lit("。"))
    return pairs.select(stable_id("qa2c_", F.col("a.parent_id"), F.col("b.parent_id"), F.lit("cmp")).alias("qa_id"), question.alias("question"), answer.alias("answer"), F.lit(2).alias("tier"), F.col("a.parent_id").alias("parent_id"), F.col("a.doc_id").alias("doc_id"), F.lit("cross_venue").alias("mining_method"))


def grounded(pairs: DataFrame, answer: str = "answer", clause: str = "clause") -> DataFrame:
    """Adds ``outcome``: accepted only where the answer stands word for word in its own clause."""
    held = F.contains(squeezed(F.col(clause)), squeezed(F.col(answer)))
    short = F.char_length(text_or_empty(F.col(answer))) < 5
    return pairs.withColumn("outcome", F.when(short, "too_short").when(held, "accepted").otherwise("not_in_clause"))


def leaks(questions: DataFrame, corpus: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Ids of questions that stand word for word in a text of the corpus, blanks aside."""
    asked = questions.select(id_col, without_blanks(F.col("text")).alias("text")).where("text <> ''")
    texts = corpus.select(without_blanks(F.col("text")).alias("text")).withColumn("held_id", F.md5(F.col("text").cast("binary")))
    return asked.select(id_col).join(containing(asked, texts, id_col, "held_id").select(id_col).distinct(), id_col, "left_semi")


def same_fact(kind: Column, subject: Column, field: Column, text: Column, gold_kind: Column, gold_subject: Column, gold_field: Column, gold_text: Column) -> Column:
    """Whether two parents state the same fact: the same cell, the same text, or one reprinted in the other."""
    table = (kind == "table_row") & (gold_kind == "table_row")
    bare = F.array(F.struct(without_blanks(text).alias("a"), without_blanks(gold_text).alias("b")))  # worked out once, then compared

    def reprinted(x: Column) -> Column:
        a_first = F.char_length(x["a"]) <= F.char_length(x["b"])
        short, long_ = F.when(a_first, x["a"]).otherwise(x["b"]), F.when(a_first, x["b"]).otherwise(x["a"])
        return (x["a"] != "") & (x["b"] != "") & ((x["a"] == x["b"]) | ((F.char_length(short) >= 30) & F.contains(long_, short)))

    texts = F.get(F.transform(bare, reprinted), F.lit(0))
    cells = (without_blanks(subject) == without_blanks(gold_subject)) & (without_blanks(field) == without_blanks(gold_field))
    return F.when(table, cells).otherwise(texts)


def hard_negatives(hits: DataFrame, gold: DataFrame, same: Column, n: int, longest: int = 1500) -> DataFrame:
    """(query_id, n_neg, neg): the best-ranked parents that are not the right one nor state its fact.

    ``hits`` is (query_id, parent_id, text, ord), ``gold`` (query_id, gold_id, gold_text); ``same`` may use both.
    """
    rows = hits.join(gold, "query_id").where(F.col("parent_id") != F.col("gold_id")).where(F.char_length("text") >= 20).where(~F.coalesce(same, F.lit(False)))
    rows = first_by(rows, ["query_id", "parent_id"], ["ord"])
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("ord"))).where(F.col("_n") <= n)
    listed = rows.groupBy("query_id").agg(F.count("*").alias("n_neg"), F.array_sort(F.collect_list(F.struct("_n", F.substring("text", 1, longest).alias("text")))).alias("neg"))
    return listed.select("query_id", "n_neg", F.transform("neg", lambda x: x["text"]).alias("neg"))


def balanced_metadata(records: Column) -> Column:
    """Titles of all records, or of none: a record without one would give itself away."""
    return F.when(F.forall(records, lambda r: F.coalesce(r["doc_title"], F.lit("")) != ""), records).otherwise(F.transform(records, lambda r: r.withField("doc_title", F.lit(""))))


def records_of(negatives: Column, metas: Column, n: int) -> Column:
    """The first n negatives with their metadata; none at all if metadata is missing for some."""
    zipped = F.transform(F.arrays_zip(negatives.alias("text"), metas.alias("meta")), lambda x: F.struct(x["text"].alias("text"), x["meta"]["doc_title"].alias("doc_title"), x["meta"]["clause_id"].alias("clause_id")))
    empty = F.slice(zipped, 1, 0)
    return F.when(F.coalesce(F.size(metas), F.lit(0)) < F.size(negatives), empty).otherwise(F.slice(zipped, 1, n))


def sample_type(key: Column, has_negatives: Column, seed: str, refusals: float = 0.15, distractions: float = 0.35) -> Column:
    r = roll(key, seed)
    return F.when(r < refusals, F.when(has_negatives, "refusal_nearmiss").otherwise("refusal_random")).when(r < refusals + distractions, "distract").otherwise("answer")


def with_gold_inserted(others: Column, gold: Column, key: Column, seed: str) -> Column:
    """(at, records): the right record at a place from 1 drawn by key and seed."""
    at = F.floor(roll(key, seed) * (F.size(others) + 1)).cast("int") + 1
    return F.struct(at.alias("at"), F.array_insert(others, at, gold).alias("records"))


def hard_eval_set(pairs: DataFrame, venues: tuple[str, ...], n: int, seed: str = "hard", method: str = "table_template", lang: str = "zh") -> DataFrame:
    """``n`` pairs in a seeded order, one for each parent, of one method, one language and some venues."""
    rows = pairs.where((F.col("mining_method") == method) & (F.col("lang") == lang) & F.col("venue").isin(*venues) & (F.col("parent_id") != ""))
    once = first_by(rows, ["parent_id"], ["qa_id"])
    return once.withColumn("_order", seeded_order(F.col("qa_id"), seed)).orderBy("_order", "qa_id").limit(n).drop("_order")


#: Parents from which one question draws its unrelated ones, about.
DRAWN_FROM = 64


def random_others(pairs: DataFrame, parents: DataFrame, k: int, seed: str = "others") -> DataFrame:
    """(qa_id, others): up to k records (text, doc_title) of parents other than the right one, in a seeded order.

    Parents are dealt into parts of about ``DRAWN_FROM``, and a question draws from the part that its hash names, so that
    questions meet few parents each. A question meets its part as one list and draws in its row: no row for each parent met is sorted.
    """
    parts = F.greatest(F.lit(1), F.floor(parents.agg(F.count("*").alias("n")).scalar() / DRAWN_FROM)).cast("long")
    dealt = lambda key: F.pmod(F.conv(F.substring(seeded_order(key, seed), 1, 8), 16, 10).cast("long"), parts)
    held = parents.where("parent_id IS NOT NULL").select(dealt(F.col("parent_id")).alias("_part"), F.struct(F.col("parent_id").alias("other"), "text", "doc_title").alias("_held"))
    held = held.groupBy("_part").agg(F.collect_list("_held").alias("_held"))  # about ``DRAWN_FROM``
    asked = pairs.where("parent_id IS NOT NULL").groupBy("qa_id").agg(F.collect_set("parent_id").alias("_own")).withColumn("_part", dealt(F.col("qa_id")))
    order = lambda x: F.struct(seeded_order(F.concat_ws("-", "qa_id", x["other"]), seed).alias("o"), x.alias("x"))
    drawn = F.slice(F.array_sort(F.transform(F.filter("_held", lambda x: ~F.array_contains("_own", x["other"])), order)), 1, k)
    met = asked.join(held, "_part").select("qa_id", F.transform(drawn, lambda d: F.struct(d["x"]["text"].alias("text"), d["x"]["doc_title"].alias("doc_title"))).alias("others"))
    return met.where(F.size("others") > 0)


def training_samples(pairs: DataFrame, parents: DataFrame, negatives: DataFrame, n_context: int = 4, seed: str = "sft") -> DataFrame:
    """(qa_id, sample_type, question, records, answer, is_refusal, gold_citation), one sample for each pair with a known parent.

    ``pairs`` is (qa_id, parent_id, question, answer), ``parents`` (parent_id, text, doc_title), ``negatives`` (qa_id,
    records) with records of (text, doc_title). A refusal shows no right record; other samples have it at a drawn place.
    Hard negatives serve refusals and distractions where there are some, random parents everything else.
    """
    gold = parents.select("parent_id", F.struct("text", "doc_title").alias("gold"))
    rows = pairs.where("answer <> ''").join(gold, "parent_id").join(negatives.select("qa_id", "records"), "qa_id", "left")
    rows = rows.join(random_others(pairs, parents, n_context, seed), "qa_id", "left")
    near = F.coalesce(F.size("records"), F.lit(0)) > 0
    kind = sample_type(F.col("qa_id"), near, seed)
    rows = rows.withColumn("sample_type", kind).withColumn("is_refusal", F.startswith("sample_type", F.lit("refusal")))
    wanted = F.when(F.col("is_refusal"), n_context).otherwise(n_context - 1)
    pool = F.when(near & (F.col("is_refusal") | (F.col("sample_type") == "distract")), F.col("records")).otherwise(F.coalesce("others", F.slice(F.array("gold"), 1, 0)))
    rows = rows.withColumn("pool", F.slice(pool, F.lit(1), wanted)).where("NOT is_refusal OR size(pool) > 0")
    placed = with_gold_inserted(F.col("pool"), F.col("gold"), F.col("qa_id"), seed + "-place")
    rows = rows.withColumn("placed", placed)
    records = F.when(F.col("is_refusal"), F.col("pool")).otherwise(F.col("placed.records"))
    refused = F.when(F.col("sample_type") == "refusal_nearmiss", REFUSALS["nearmiss"]).otherwise(REFUSALS["random"])
    cited = F.when(~F.col("is_refusal"), F.col("placed.at"))
    answer = F.coalesce(F.concat("answer", F.lit("["), cited.cast("string"), F.lit("]")), refused)
    return rows.select("qa_id", "sample_type", "question", balanced_metadata(records).alias("records"), answer.alias("answer"), "is_refusal", cited.alias("gold_citation"))
