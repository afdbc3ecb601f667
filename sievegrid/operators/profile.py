"""Counts that describe a corpus or a question set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """(dimension, value, docs, chars): totals and a breakdown by each column, in one pass over the table."""
    rows = docs.select(*by, F.char_length(text_col).cast("long").alias("chars"))
    sets = [[F.col(c)] for c in by] + [[]]
    grouped = rows.groupingSets(sets, *by).agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), *[F.grouping(c).alias(f"_g_{c}") for c in by])
    dimension, value = F.lit("all"), F.lit(None).cast("string")
    for c in by:
        dimension, value = F.when(F.col(f"_g_{c}") == 0, c).otherwise(dimension), F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "docs", "chars")


def outcomes(tagged: DataFrame, column: str = "outcome") -> DataFrame:
    """(outcome, n, share)."""
    counted = tagged.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / tagged.agg(F.count("*").alias("all")).scalar(), 6))


def describe_gold(gold: DataFrame) -> DataFrame:
    """(mining_method, n, paraphrased): what a question set is made of, read off the data alone."""
    return gold.groupBy("mining_method").agg(F.count("*").alias("n"), F.count_if(F.endswith("qa_id", F.lit("_pp"))).alias("paraphrased"))


def negatives(rows: DataFrame, want: int, column: str = "n_neg") -> DataFrame:
    """One row: questions, their negatives in all and in the mean, and how many have fewer than wanted; no rows give a null mean."""
    n = F.col(column)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("negatives"), F.round(F.avg(n), 4).alias("mean"), F.count_if(n < want).alias("short"))
