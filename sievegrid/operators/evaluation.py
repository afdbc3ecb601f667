"""Retrieval metrics against one right answer per question, and answer checks, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
NUMBER = r"\d+(?:[,，]\d{3})*(?:\.\d+)?%?|\d{1,2}:\d{2}"
PIECE = r"\d+(?:\.\d+)?%?|[一-鿿]{2,}|[A-Za-z]{3,}"


def rank_of(ids: Column, gold: Column) -> Column:
    """Position from 1 of the first match, null for a miss."""
    return F.nullif(F.array_position(ids, gold), F.lit(0))


def gold_ranks(gold: DataFrame, hits: DataFrame, key: str = "child_id") -> DataFrame:
    """(query_id, rank): the rank of the right answer; misses have none but stay."""
    found = hits.join(gold.select("query_id", F.col("gold").alias(key)), ["query_id", key]).groupBy("query_id").agg(F.min("ord").alias("rank"))
    return gold.select("query_id").join(found, "query_id", "left")


def metrics(ranks: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = KS) -> DataFrame:
    """n, recall, nDCG and mean reciprocal rank over (query_id, rank), a miss counting as 0."""
    out = [F.count("*").alias("n")]
    for k in ks:
        hit = F.coalesce(F.col("rank") <= k, F.lit(False))
        out.append(F.round(F.avg(hit.cast("double")), 6).alias(f"recall_{k}"))
        out.append(F.round(F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}"))
    out.append(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
    return ranks.groupBy(*by).agg(*out)


def value_at(rows: DataFrame, value: str, by: tuple[str, ...], share: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    """(by, n, value): the value at index floor(share * n) of each group's sorted values, nulls aside.

    Two approximate percentiles enclose it, by the accuracy that they guarantee; only what lies between them is
    counted value by value, so no group is gathered or sorted whole.
    """
    held = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("_k"), F.col(value).alias("_v")).where("_v IS NOT NULL")  # a struct joins null keys too
    low, high = (F.approx_percentile("_v", F.lit(min(1.0, max(0.0, share + x / accuracy))), F.lit(accuracy)) for x in (-2, 2))
    bounds = held.groupBy("_k").agg(F.count("*").alias("n"), low.alias("_low"), high.alias("_high"))
    both = held.join(bounds, "_k")
    below = both.groupBy("_k").agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"))
    band = both.where("_v BETWEEN _low AND _high").groupBy("_k", "n", "_v").agg(F.count("*").alias("_same")).join(below, "_k")
    upto = F.col("_below") + F.sum("_same").over(W.partitionBy("_k").orderBy("_v"))
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    found = band.withColumn("_upto", upto).where(F.col("_upto") > at).groupBy("_k", "n").agg(F.min("_v").alias(value))
    return found.select(*[F.col("_k")[c].alias(c) for c in by], "n", value)


def numeric_fidelity(answer: Column, gold: Column) -> Column:
    """Share of the right answer's distinct numbers that the answer holds; null if it has none."""
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), "[,，]", "")
    numbers = F.array_distinct(F.regexp_extract_all(F.coalesce(gold, F.lit("")), F.lit(NUMBER), F.lit(0)))
    held = F.size(F.filter(numbers, lambda x: F.contains(plain, F.regexp_replace(x, "[,，]", ""))))
    return F.when(F.size(numbers) > 0, held / F.size(numbers))


def keyword_coverage(answer: Column, gold: Column, shortest: int = 2) -> Column:
    """Share of the right answer's distinct numbers and words that the answer holds; 0 if it has none."""
    pieces = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(gold, F.lit("")), F.lit(PIECE), F.lit(0)), lambda x: F.char_length(x) >= shortest))
    held = F.size(F.filter(pieces, lambda x: F.contains(F.coalesce(answer, F.lit("")), x)))
    return F.when(F.size(pieces) > 0, held / F.size(pieces)).otherwise(F.lit(0.0))


def generation_summary(scores: DataFrame, fidelity: str = "fidelity", coverage: str = "coverage", enough: float = 0.6, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of ``by``, such as a question's place in its conversation: answers, how many have numbers to check, and means and shares of both scores; nulls count in neither."""
    exact = F.when(F.col(fidelity).isNotNull(), (F.col(fidelity) == 1.0).cast("double"))
    return scores.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(fidelity).alias("fidelity_n"),
        F.round(F.avg(fidelity), 4).alias("fidelity_mean"),
        F.round(F.avg(exact), 4).alias("fidelity_all_right"),
        F.round(F.avg(coverage), 4).alias("coverage_mean"),
        F.round(F.avg((F.col(coverage) >= enough).cast("double")), 4).alias("coverage_enough"),
    )


def against_baseline(results: DataFrame, baseline: str, by: str = "stage", measure: str = "recall_5") -> DataFrame:
    """Results with ``gain``, the difference to the baseline's measure in percentage points."""
    base = results.where(F.col(by) == baseline).agg(F.max(measure)).scalar()
    return results.withColumn("gain", F.round(100 * (F.col(measure) - base), 2))


def as_markdown(results: DataFrame, by: str = "stage") -> Column:
    """An aggregate of ``results``, few rows as they are, as one Markdown table in the order of ``by``."""
    cells = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    head = "\n".join(("| " + " | ".join(results.columns) + " |", "|" + "-|" * len(results.columns)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(by), cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in results.columns]).alias("line"))))
    return F.concat_ws("\n", F.lit(head), F.transform(rows, lambda x: x["line"]))
