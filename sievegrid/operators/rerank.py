"""Second-stage ranking of few candidates by a pluggable scorer.

The scorer is an Arrow UDF of (query, text); it stands above the cut to the merged candidates, so a costly model sees
at most those. ``overlap`` is a deterministic stand-in made of built-ins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import words
from sievegrid.operators.bm25 import top

KEEP = 5
Scorer = Callable[[Column, Column], Column]


def overlap(query: Column, text: Column) -> Column:
    """A logit from the share of the query's distinct words that the text holds."""
    wanted = F.array_distinct(words(query))
    share = F.size(F.array_intersect(wanted, words(text))) / F.greatest(F.size(wanted), F.lit(1))
    return F.round(12 * share - 6, 6)


def rerank(hits: DataFrame, scorer: Scorer = overlap, k: int = KEEP, query: str = "query", text: str = "text") -> DataFrame:
    """The best k by the scorer; the merged score and rank are kept beside the new ones."""
    k = k or KEEP
    seen = hits.withColumnsRenamed({"score": "fused_score", "ord": "fused_rank"}).withColumn("score", scorer(F.col(query), F.col(text)))
    return top(seen, k, (F.desc("score"), F.col("fused_rank")))
