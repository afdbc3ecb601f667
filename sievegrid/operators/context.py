"""What a ranked answer shows: parent texts, citations, a budgeted context and a measure of confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.functions.text import REPEALED, SUPERSEDED, UNKNOWN, text_or_empty
from sievegrid.functions.vectors import sigmoid

BUDGET = 12_000
SEPARATOR = "\n\n---\n\n"
HIGH, MEDIUM, CLOSE = 0.80, 0.50, 1.0


def attach_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds ``parent_text`` from (parent_id, text); a hit without a known parent keeps its own text alone."""
    return hits.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")


def _joined(parts: list[Column], sep: str = " · ") -> Column:
    return F.array_join(F.filter(F.array(*[text_or_empty(p.cast("string")) for p in parts]), lambda x: x != ""), sep)


def citation(title: Column, number: Column, clause: Column, url: Column, child: Column) -> Column:
    return F.coalesce(F.nullif(_joined([title, number, clause]), F.lit("")), F.nullif(url, F.lit("")), child.cast("string"))


def citations(hits: DataFrame) -> DataFrame:
    """Numbered citations; the text shown is the parent's where there is one, scores have four digits."""
    return hits.select("query_id", F.col("ord").alias("index"), "child_id", F.coalesce("parent_text", "text").alias("text"), F.col("text").alias("snippet"), F.round("score", 4).alias("score"), F.transform_values("scores", lambda _, v: F.round(v, 4)).alias("scores"), "ranks")


def blocks(hits: DataFrame, title: str | None = None, number: str | None = None, clause: str | None = None, status: str | None = None, body: str = "text") -> DataFrame:
    """Adds ``block``: a header of what is known about the source over the body."""
    bits = [F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]"))] + [F.col(c) for c in (title, number, clause) if c]
    if status:
        bits.append(F.when(~F.col(status).isin("", UNKNOWN), F.concat(F.lit("["), F.col(status), F.lit("]"))))
    return hits.withColumn("block", F.concat(_joined(bits), F.lit("\n"), text_or_empty(F.col(body))))


def contexts(numbered: DataFrame, budget: int = BUDGET, separator: str = SEPARATOR) -> DataFrame:
    """(query_id, n_blocks, used, context): blocks in rank order while their lengths, without separators, fit."""
    used = F.sum(F.char_length("block").cast("long")).over(W.partitionBy("query_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    fit = numbered.withColumn("_used", used).where(F.col("_used") <= budget)
    grouped = fit.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.max("_used").alias("used"), F.array_sort(F.collect_list(F.struct("ord", "block"))).alias("parts"))
    return grouped.select("query_id", "n_blocks", "used", F.array_join(F.transform("parts", lambda x: x["block"]), separator).alias("context"))


def confidence(hits: DataFrame, queries: DataFrame, reranked: bool = True, status: str = "effective_status") -> DataFrame:
    """(query_id, level, probability, margin, ambiguous, stale): from the first two scores in the order returned."""
    first = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("ord") == 1, F.col("score"))).alias("top"),
        F.max(F.when(F.col("ord") == 2, F.col("score"))).alias("next"),
        F.count_if(F.col(status).isin(REPEALED, SUPERSEDED)).alias("stale"),
    )
    rows = queries.select("query_id").join(first, "query_id", "left")
    rated = F.lit(reranked) & F.col("top").isNotNull()
    chance = sigmoid(F.col("top"))
    margin = F.when(rated, F.round(F.col("top") - F.col("next"), 4))
    level = F.when(F.col("top").isNull(), "low").when(~F.lit(reranked), "unknown").when(chance >= HIGH, "high").when(chance >= MEDIUM, "medium").otherwise("low")
    probability = F.when(F.col("top").isNull(), F.lit(0.0)).when(F.lit(reranked), F.round(chance, 4))
    return rows.select("query_id", level.alias("level"), probability.alias("probability"), margin.alias("margin"), F.coalesce(margin < CLOSE, F.lit(False)).alias("ambiguous"), F.coalesce("stale", F.lit(0)).alias("stale"))
