"""Word documents: paragraphs with their automatic numbers, and tables, in order.

A file is a zip of XML that no built-in reads, so each file is one row of an Arrow function over binaryFile.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.functions.numerals import list_label

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path STRING, ord INT, kind STRING, text STRING, cells ARRAY<ARRAY<STRING>>, abstract_id STRING, level INT, level_text STRING, level_form STRING, level_start INT"


def _value(node, name: str) -> str | None:
    child = node.find(f"{_W}{name}") if node is not None else None
    return child.get(f"{_W}val") if child is not None else None


def _text(node) -> str:
    return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter()).strip()


def _numbering(archive: zipfile.ZipFile) -> tuple[dict[str, str], dict[tuple[str, int], tuple[str, str, int]]]:
    """(list to abstract list, (abstract list, level) to label text, form and first number)."""
    if "word/numbering.xml" not in archive.namelist():
        return {}, {}
    root = ElementTree.fromstring(archive.read("word/numbering.xml"))
    lists = {n.get(f"{_W}numId"): _value(n, "abstractNumId") for n in root.findall(f"{_W}num")}
    levels = {}
    for a in root.findall(f"{_W}abstractNum"):
        for level in a.findall(f"{_W}lvl"):
            levels[a.get(f"{_W}abstractNumId"), int(level.get(f"{_W}ilvl"))] = (_value(level, "lvlText") or "", _value(level, "numFmt") or "decimal", int(_value(level, "start") or 1))
    return lists, levels


def _blocks(path: str, content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        lists, levels = _numbering(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    out = []
    for i, node in enumerate(body):
        if node.tag == f"{_W}p":
            own = node.find(f"{_W}pPr/{_W}numPr")
            number, level = _value(own, "numId"), int(_value(own, "ilvl") or 0)
            abstract = lists.get(number)
            text, form, start = levels.get((abstract, level), (None, None, None)) if abstract else (None, None, None)
            out.append((path, i, "paragraph", _text(node), None, abstract if text is not None else None, level, text, form, start))
        elif node.tag == f"{_W}tbl":
            cells = [[_text(c) for c in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            out.append((path, i, "table", None, cells, None, None, None, None, None))
    return out


def read_docx_blocks(files: DataFrame) -> DataFrame:
    """One row per paragraph or table of (path, content); a file that can't be read gives one row of kind ``error``."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += _blocks(path, bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, 0, "error", f"{type(e).__name__}: {e}", None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=names).astype({"level": "Int32", "level_start": "Int32"})

    return files.select("path", "content").mapInPandas(each, SCHEMA)


LEVELS = 9
FORMS = ("decimal", "chineseCounting", "chineseCountingThousand", "japaneseCounting", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "decimalEnclosedCircle", "bullet", "none")


def numbered_paragraphs(blocks: DataFrame) -> DataFrame:
    """(path, ord, text): paragraphs with the numbers that a word processor would show before them.

    A level's counter starts anew after any paragraph of a higher level of the same list; lists that share a
    definition share counters. Counters are window sums over a document's paragraphs.
    """
    rows = blocks.where("kind = 'paragraph'")
    upto = W.partitionBy("path", "abstract_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    runs = rows.select("*", *[F.sum(F.when(F.col("level") < i, 1).otherwise(0)).over(upto).alias(f"_run{i}") for i in range(LEVELS)])
    counts = []
    for i in range(LEVELS):
        within = W.partitionBy("path", "abstract_id", f"_run{i}").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
        counts.append(F.sum(F.when(F.col("level") == i, 1).otherwise(0)).over(within).cast("int").alias(f"_n{i}"))
    counted = runs.select("*", *counts)
    own = F.get(F.array(*[F.col(f"_n{i}") for i in range(LEVELS)]), F.col("level")) + F.coalesce("level_start", F.lit(1)) - 1
    counted = counted.withColumn("_own", own)
    label = F.replace("level_text", F.concat(F.lit("%"), (F.col("level") + 1).cast("string")), _label(F.col("_own")))
    for i in range(LEVELS):
        label = F.replace(label, F.lit(f"%{i + 1}"), F.greatest(F.col(f"_n{i}"), F.lit(1)).cast("string"))
    text = F.when(F.col("abstract_id").isNull() | (F.coalesce("level_text", F.lit("")) == ""), F.col("text")).otherwise(F.concat(label, F.lit(" "), "text"))
    return counted.select("path", "ord", F.trim(text).alias("text"))


def _label(n):
    out = n.cast("string")
    for form in FORMS:
        out = F.when(F.col("level_form") == form, list_label(n, form)).otherwise(out)
    return out
