"""The keyword channel: what a question names outright, matched on metadata instead of text.

Clause references are held to the documents that the question names; where these lack the clause, the
same clause anywhere is taken, but not as an exact match. Document numbers are always exact. Contract codes are
looked up by BM25.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.functions.text import REPEALED, references
from sievegrid.operators import bm25
from sievegrid.operators.containment import containing


def not_repealed(rows: DataFrame, status: str = "effective_status") -> DataFrame:
    """Drops what is known to be repealed; an unknown or null status stays."""
    return rows.where(~F.col(status).eqNullSafe(F.lit(REPEALED)))


def named_documents(queries: DataFrame, children: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose title holds, or is held by, a title in the question."""
    asked = queries.select("query_id", F.explode(references(F.col("text"), "title")).alias("text")).distinct()
    titles = children.select("doc_id", F.col("doc_title").alias("text")).where("text <> ''").distinct()
    named, known = (df.select(F.md5(F.col("text").cast("binary")).alias(name), "text").distinct() for df, name in ((asked, "named"), (titles, "title")))
    both = containing(named, known, "named", "title").unionByName(containing(known, named, "title", "named")).distinct()
    key = F.md5(F.col("text").cast("binary"))
    return asked.select("query_id", key.alias("named")).join(both, "named").join(titles.select("doc_id", key.alias("title")), "title").select("query_id", "doc_id").distinct()


def _first(children: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first children of each key. A question's hits are lists in order of (branch, at), each by child, without those of the lists before.

    A list is only reached if those before it have less than k children together, so that of its first 2k at least k are new.
    """
    order = W.partitionBy(*keys).orderBy("child_id")
    return children.select(*keys, "child_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * k).drop("n")


def keyword_hits(queries: DataFrame, children: DataFrame, index: bm25.Index | None = None, k: int = 20) -> DataFrame:
    """(query_id, child_id, score, ord, exact) for children (child_id, doc_id, doc_title, clause_id, doc_no, effective_status)."""
    documents = named_documents(queries, children)
    valid = not_repealed(children)
    asked = queries.select("query_id", F.posexplode(references(F.col("text"), "clause")).alias("at", "clause_id"))
    held = children.select("doc_id", "clause_id").distinct()  # of repealed children too: a named clause that is repealed has no stand-in
    named = asked.join(documents, "query_id").join(held, ["doc_id", "clause_id"])
    elsewhere = asked.join(named.select("query_id", "at"), ["query_id", "at"], "left_anti")
    scoped = named.join(_first(valid, k, "doc_id", "clause_id"), ["doc_id", "clause_id"]).select("query_id", "child_id", F.lit(True).alias("exact"), F.lit(0).alias("branch"), "at")
    anywhere = elsewhere.join(_first(valid, k, "clause_id"), "clause_id").select("query_id", "child_id", F.lit(False).alias("exact"), F.lit(0).alias("branch"), "at")

    numbers = queries.select("query_id", F.posexplode(F.transform(references(F.col("text"), "doc_no"), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))).alias("at", "doc_no"))
    numbers = numbers.join(_first(valid, k, "doc_no"), "doc_no").select("query_id", "child_id", F.lit(True).alias("exact"), F.lit(1).alias("branch"), "at")
    hits = scoped.union(anywhere).union(numbers).select("query_id", "child_id", F.lit(1.0).alias("score"), "exact", "branch", "at")
    if index is not None:
        codes = queries.select("query_id", F.posexplode(references(F.col("text"), "code")).alias("at", "text"))
        codes = codes.withColumn("asked", F.struct("query_id", "at"))
        found = bm25.search(index, codes.select(F.col("asked").alias("query_id"), "text"), k).join(valid.select("child_id"), "child_id", "left_semi")
        hits = hits.union(found.select("query_id.query_id", "child_id", "score", F.lit(False).alias("exact"), F.lit(2).alias("branch"), "query_id.at"))

    order = W.partitionBy("query_id", "child_id").orderBy("branch", "at")
    once = hits.withColumn("n", F.row_number().over(order)).where("n = 1")
    return bm25.top(once, k, ("branch", "at", "child_id")).select("query_id", "child_id", "score", "ord", "exact")
