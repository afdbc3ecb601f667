"""URL filter: rules first, then words segmented from host and path, scored by multinomial naive Bayes.

Runs of letters in host and path are split into words by a unigram model: Viterbi finds the split of the highest
probability, where an unlisted word gets less the longer it is. The model's counts are those of the words of a corpus.
Naive Bayes learns its word odds from labelled texts, smoothed in proportion to the classes, so that a word that was
never labelled says nothing. Counts, odds and scores are Spark aggregations and joins: the distinct runs of all URLs are
split once each, with the words that lie in them joined to them, so no dictionary is sent to the tasks or cut to fit.

Words are runs of A-Z letters in any case, of at most ``LONGEST_WORD`` letters; longer ones are no words of the model, and
what stands in a URL for them is split like anything unlisted.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the prior
alone; a score of exactly 0 allows; of rules of equal length that fit, the first stands; any length and repeated rows
are judged whole and row by row; null ids are kept; without labels every word's odds are 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.lines import ascii_lower
from sievegrid.llm.shared import Table, keep, read_table, scratch

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LONGEST_WORD = 40
#: Weight of the classes' own proportion in a word's odds, in occurrences.
SMOOTHING = 10.0
#: The largest number of labelled texts that the odds are learnt from, those of the smallest hash of their id.
SAMPLE = 20_000
#: Share of addresses taken to be bad before a word is read.
PRIOR = 0.1
#: What each letter of an unlisted word costs, besides a word that was seen once.
LETTER_COST = math.log(10)


def with_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path): host with A-Z lower-cased, and path, as they stand in the url."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    host, path = (F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), ascii_lower(host).alias("host"), path.alias("path"))


def by_rule(rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, said in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((F.col("host") == own) | F.endswith("host", F.lit("." + own))) & F.startswith("path", F.lit(start))
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def words_of(text: Column) -> Column:
    found = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", -1)
    return F.filter(found, lambda w: w.rlike(f"^[a-z]{{1,{LONGEST_WORD}}}$"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts."""
    return docs.select(F.explode(words_of(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_odds(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, smoothing: float = SMOOTHING, sample: int = SAMPLE) -> DataFrame:
    """(word, odds) from texts labelled 1 (bad) or 0 whose crc32(id) leaves a remainder of ``folds``; the others are held out.

    At most ``sample`` labels are used, so that they are sent to the tasks and no text is moved.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(f"id IS NOT NULL AND label IN (0, 1) AND crc32(CAST(id AS STRING)) % {folds} <> 0")
    usable = usable.orderBy(F.md5(F.concat(F.lit("url-"), F.col("id").cast("string")).cast("binary")), "label").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(usable), "id")
    seen = rows.select("label", F.explode(words_of(F.col("text"))).alias("word")).groupBy("word")
    seen = Table(seen.agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")), "url-labelled-words").df
    bad, good = seen.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    share = bad / (bad + good) if bad and good else 0.5
    held = bool(bad and good)  # one class alone tells nothing
    odds = F.log((F.col("bad") + smoothing * share) / (F.col("good") + smoothing * (1 - share))) - math.log(share / (1 - share))
    return seen.select("word", odds.alias("odds") if held else F.lit(0.0).alias("odds"))


def best_split(run: str, known: dict[tuple[int, int], float], rare: float) -> list[str]:
    """Viterbi over the ends of words: ``known`` has the cost of each listed word by its place (from, to).

    A stretch without listed words stays one unlisted word, of cost ``rare`` and ``LETTER_COST`` a letter.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for (start, end), cost in known.items():
        ends.setdefault(end, []).append((start, cost))
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    open_cost, open_from = math.inf, 0
    for end in range(1, len(run) + 1):
        start, grown = best[end - 1] + rare + LETTER_COST, open_cost + LETTER_COST
        open_cost, open_from = (start, end - 1) if start <= grown else (grown, open_from)
        best[end], back[end] = open_cost, open_from
        for at, cost in sorted(ends.get(end, ())):
            if best[at] + cost < best[end]:
                best[end], back[end] = best[at] + cost, at
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for distinct ``run``; ``counts`` is a written (word, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    rare = math.log(total)
    at = F.explode(F.sequence(F.lit(0), F.char_length("run") - 1)).alias("at")
    inside = runs.select("run", at).select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.char_length("run") - F.col("at")))).alias("size"))
    inside = inside.withColumn("word", F.substring("run", F.col("at") + 1, F.col("size")))
    found = inside.join(counts.select("word", (rare - F.log("n")).alias("cost")), "word").groupBy("run")
    found = found.agg(F.collect_list("at").alias("at"), F.collect_list("size").alias("size"), F.collect_list("cost").alias("cost"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(best_split(run, {(a, a + n): cost for a, n, cost in zip(*(x or () for x in lists))}, rare))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    both = runs.join(found, "run", "left").select("run", "at", "size", "cost")
    return both.mapInArrow(split, "run string, words array<string>")


def judge(pages: DataFrame, counts: DataFrame, odds: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, prior: float = PRIOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per row of ``pages``; ``counts`` and ``odds`` are written tables."""
    rows = with_parts(pages, id_col, url_col)
    with scratch():
        addresses = Table(rows.select("host", "path").distinct(), "url-addresses").df
        runs = F.regexp_extract_all(ascii_lower(F.concat_ws(" ", "host", "path")), F.lit("[a-z]+"), F.lit(0))
        placed = Table(addresses.select("host", "path", F.explode(runs).alias("run")), "url-runs").df
        split = Table(segmented(placed.select("run").distinct(), counts), "url-words").df
        rated = split.select("run", F.explode("words").alias("word")).join(odds, "word").groupBy("run").agg(F.sum("odds").alias("odds"))
        scores = placed.join(rated, "run").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
        scores = keep(Table(scores, "url-scores")).df
    score = F.coalesce("odds", F.lit(0.0)) + math.log(prior / (1 - prior))
    rule, verdict = by_rule(rules)
    out = rows.join(scores, ["host", "path"], "left").withColumn("score", score)
    verdict = F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op2_urlfilter(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = Table(word_counts(docs), "url-counts").df
    odds = Table(word_odds(docs, read_table(spark, sf_dir, "labels")), "url-odds").df
    return judge(read_table(spark, sf_dir, "pages"), counts, odds)
