"""Document titles from several witnesses, and the headings above a place in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.functions.text import strip, text_or_empty

# Names that sites append to their titles, and heading words from the highest level down.
SITES = "中国金融期货交易所|上海证券交易所|深圳证券交易所|上海期货交易所|大连商品交易所|郑州商品交易所|SGX|HKEX|Rulebooks?"
HEADINGS = ("编", "部分", "章", "节")
HEADING = r"(?U)^\s*(第[一二三四五六七八九十百千零〇\d]{1,10}(?:章|节|编|部分))\s*(.{0,40})$"


def cleaned_title(title: Column) -> Column:
    """Without up to three appended site names, and only what stands before a bar that is left."""
    out = strip(F.regexp_replace(text_or_empty(title), r"(?U)\s+", " "))
    out = strip(F.regexp_replace(out, rf"(?U)(?:\s*[|｜_\-–—]\s*(?:{SITES})\s*){{1,3}}$", ""))
    return strip(F.split(out, "[|｜]", -1)[0])


def title_in_notes(notes: Column) -> Column:
    return F.when(F.startswith(text_or_empty(notes), F.lit("title=")), strip(F.substring_index(F.substring(notes, F.lit(7), F.char_length(notes)), "|", 1)))


def resolved_titles(docs: DataFrame, catalogue: DataFrame, shortest_pdf: int = 6) -> DataFrame:
    """Adds ``doc_title``: the catalogue's, else the parsed one, else the notes', else a PDF's own, else the id.

    ``docs`` has (doc_id, title, notes, pdf_title), ``catalogue`` (doc_id, title).
    """
    named = catalogue.where("title <> ''").select("doc_id", strip(F.col("title")).alias("_named"))

    def unlike_id(x: Column) -> Column:
        return F.when((x != "") & (x != F.col("doc_id")), x)

    pdf = cleaned_title(F.col("pdf_title"))
    best = F.coalesce("_named", unlike_id(cleaned_title(F.col("title"))), unlike_id(cleaned_title(title_in_notes(F.col("notes")))), F.when(F.char_length(pdf) >= shortest_pdf, pdf), F.col("doc_id"))
    return docs.join(named, "doc_id", "left").withColumn("doc_title", best).drop("_named")


def section_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, path): for each line the latest heading of every level, none from under an older heading."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_or_empty(F.col("text")), "\n", -1)).alias("line_no", "line"))
    marker = F.regexp_extract("line", HEADING, 1)
    level = F.lit(None).cast("int")
    for i, word in reversed(list(enumerate(HEADINGS))):
        level = F.when(F.endswith(marker, F.lit(word)), i).otherwise(level)
    label = strip(F.concat(marker, F.lit(" "), F.regexp_extract("line", HEADING, 2)))
    rows = lines.withColumn("_level", F.when(marker != "", level)).withColumn("_label", label)
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("_level") == i, F.struct(F.col("line_no").alias("at"), F.col("_label").alias("label"))), ignorenulls=True).over(upto).alias(f"_h{i}") for i in range(len(HEADINGS))]
    rows = rows.select("doc_id", "line_no", "line", *last)
    shown = []
    for i in range(len(HEADINGS)):
        above = F.greatest(*[F.coalesce(F.col(f"_h{j}.at"), F.lit(-1)) for j in range(i)], F.lit(-1), F.lit(-1))
        shown.append(F.when(F.col(f"_h{i}.at") > above, F.col(f"_h{i}.label")))
    return rows.select("doc_id", "line_no", "line", F.filter(F.array(*shown), lambda x: x.isNotNull()).alias("path"))
