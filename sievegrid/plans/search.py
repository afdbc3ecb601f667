"""Hybrid retrieval of many questions in one plan: channels, fusion, parents, second-stage ranking, pins, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.operators import bm25, context, dense, fusion, keyword, rerank

TOP = {"bm25": 50, "dense": 50, "keyword": 20}


def candidates(queries: DataFrame, children: DataFrame, index: bm25.Index | None = None, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, with_keyword: bool = False) -> dict[str, DataFrame]:
    """Ranked hits by channel; repealed children are set aside before the cut, in every channel alike."""
    usable = keyword.not_repealed(children) if "effective_status" in children.columns else children
    out = {}
    among = usable if index is not None and usable is not children else None  # an index that was given may hold repealed children
    index = index or bm25.build(usable)
    out["bm25"] = bm25.search(index, queries, TOP["bm25"], among)
    if query_vectors is not None:
        out["dense"] = dense.knn(query_vectors, vectors.join(usable.select("child_id"), "child_id", "left_semi"), TOP["dense"])
    if with_keyword:
        out["keyword"] = keyword.keyword_hits(queries, children, index, TOP["keyword"])  # a named clause that is repealed has no stand-in
    return out


def search(queries: DataFrame, children: DataFrame, parents: DataFrame | None, channels: dict[str, DataFrame], want: int = rerank.KEEP, alpha: float = fusion.ALPHA, scorer: rerank.Scorer | None = rerank.overlap) -> DataFrame:
    """(query_id, ord, child_id, parent_id, text, parent_text, score, fused_score, fused_rank, ranks, scores, pinned).

    ``scorer`` None keeps the merged order. Exact keyword matches are pinned from the merged pool.
    """
    merged = fusion.fuse(channels, alpha=alpha)
    pool = fusion.first_per_parent(merged.join(children.select("child_id", "parent_id", "text"), "child_id"))
    pool = context.attach_parents(pool, parents) if parents is not None else pool.withColumn("parent_text", F.lit(None).cast("string"))
    final = pool.withColumn("fused_score", F.col("score")).withColumn("fused_rank", F.col("ord"))
    if scorer is not None:
        asked = pool.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        final = rerank.rerank(asked, scorer, want).drop("query")
    final = final.where(F.col("ord") <= (want or rerank.KEEP))
    if "keyword" in channels:
        exact = channels["keyword"].where("exact").select("query_id", "child_id", "ord")
        pool = pool.withColumn("fused_score", F.col("score")).withColumn("fused_rank", F.col("ord"))
        return fusion.pin(final, pool, exact, want or rerank.KEEP)
    return final.withColumn("pinned", F.lit(False))
