"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read back as the next one's
docs. All but the last return the columns of ``documents``; other columns fall away, whatever their names.

Defined results, in all stages: a stage decides by row, so rows that share an id, or have none, are rows like any other;
null and empty texts are documents, which each stage treats as its docstring says; a null language or source is a leaf
of its own in the mixing; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm import lines, mixing, nearcopies, packing, quality
from sievegrid.llm.shared import Table, keep, read_table, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tokens that mixing keeps, in thousandths of what reaches it; one epoch, so no document comes twice.
MIX_SHARE = 900


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a text without words has the bias alone as its score.

    Rows whose id is null or labelled with neither 0 nor 1 never train. Equal texts have equal scores, so copies go together.
    """
    docs = docs.select(*COLUMNS)
    weights = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.add_score(docs, weights).where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many distinct texts go; a document that had nothing else goes with them.

    A text counts once however many documents have it, as ``drop_near_copies`` is to keep one of them. Null and empty
    texts have one empty line, which is too short to drop, so they stay as they are; the order of lines stays.
    """
    out = lines.drop_repeated_lines(docs.select(*COLUMNS), per=F.xxhash64("text")).where("n_dropped = 0 OR kept_text <> ''")
    same = F.col("n_dropped") == 0
    text = F.when(same, F.col("row.text")).otherwise(F.col("kept_text"))
    n_chars = F.when(same, F.col("row.n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: one of the smallest id.

    Rows are told apart by a number of their own, so ids may repeat, be shared by different texts or be null; a null id
    comes after all others, and of rows with the same id the first read stays.
    Near-duplicates share 0.8 of their five-word shingles; ``op4_simhash`` keeps its own, stricter contract. Null, empty
    and blank texts are copies of each other.
    """
    rows = Table(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "near-rows").df
    classes = Table(rows.select("row_id", "doc_id").join(nearcopies.groups(rows), "row_id"), "near-groups").df
    first = classes.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first"))
    return rows.join(first.select("first.row_id"), "row_id", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought towards their target weights; each row comes at most once.

    Rows without tokens take part: they come where their place in a leaf's seeded order lies within its prefix.
    """
    out = mixing.mix(docs.select(*COLUMNS), mixing.document_levels(), list(mixing.LEVELS), mixing.WEIGHTS, share=MIX_SHARE, epochs=1)
    return out.select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut and packed into training sequences; a null or empty text is a piece of the end id alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training, tokenising and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; what a stage has written goes when the next one has been written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            after = keep(Table(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
