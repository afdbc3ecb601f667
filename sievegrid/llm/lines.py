"""Line dedup: lines found in many documents lose all their copies.

Lines are keyed by a hash of their normal form; a document counts once for each key it holds, in its own row
before any shuffle, so a line of every document is one partial count per task. Keys over the threshold are written
as a table. Up to ``MOST_SENT`` of them are sent to the tasks, which drop lines row by row without moving a text. More are
joined by key, where Spark splits hot keys; each document is then told the positions of its dropped lines and joins what
lies between them.

Defined results: null and empty texts have one empty line; rows that share an id are one document, and a row without one is a document of
its own; every row is judged by itself; keys shorter than ``min_chars`` code points never drop, ties don't arise; a document
that loses all lines keeps an empty text; very long texts are read whole, a few at a time; an empty table gives an empty
result; other columns are kept untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievegrid.llm.shared import Table, read_table

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys that are sent to the tasks, 16 bytes each and some 80 more in a Python set; more are joined.
MOST_SENT = 1 << 20
_AT_ONCE = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z only; texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(_BLANKS))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _hashes(lines: Column, min_chars: int) -> Column:
    """A hash for each line, null for keys that are too short to drop."""

    def one(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.md5(key.cast("binary")))

    return F.transform(lines, one)


def _dropped_in_rows(docs: DataFrame, text_col: str, frequent: DataFrame, min_chars: int) -> DataFrame:
    keys = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(x.key) for x in frequent.collect()))  # ``MOST_SENT`` at most
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop, blanks = keys.value, _BLANKS.encode()
        for part in (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE)):
            kept_texts, n_lines, n_dropped = [], [], []
            for text in pc.struct_field(part.column(0), text_col):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                kept = []
                for line in lines:
                    key = line.lower().strip(blanks)  # bytes: only A-Z
                    if len(key) < min_chars or md5(key).digest() not in drop or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
                        kept.append(line)
                kept_texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept_texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["row", "kept_text", "n_lines", "n_dropped"])

    kinds = StructType([rows.schema["row"], *StructType.fromDDL("kept_text string, n_lines long, n_dropped long")])
    return rows.mapInArrow(each, kinds)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, per: Column | None = None) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): ``row`` is a struct of the given columns.

    A line counts once for each id; with ``per`` once for each value of it that is not null. Lines are told apart by id only in
    rows that share theirs with others, so that elsewhere one partial count for each key leaves a task.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _hashes(_lines(text_col), min_chars).alias("keys"), *([] if per is None else [per.alias("unit")]))
    unit = [] if per is None else ["unit"]
    counted = own.select(F.explode(F.array_distinct("keys")).alias("hex"), *unit).where("hex IS NOT NULL").select(F.unhex("hex").alias("key"), *unit)
    if per is not None:
        counts = counted.where("unit IS NOT NULL").distinct().groupBy("key").agg(F.count("*").alias("n"))
    else:
        shared = Table(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared-ids")
        if shared.df.isEmpty():
            counts = counted.groupBy("key").agg(F.count("*").alias("n"))
        else:
            keyed = lambda rows: rows.select("id", F.explode(F.array_distinct("keys")).alias("hex")).where("hex IS NOT NULL").select(F.unhex("hex").alias("key"), "id")
            alone = keyed(own.join(shared.df, "id", "left_anti")).groupBy("key").agg(F.count("*").alias("n"))
            together = keyed(own.join(shared.df, "id", "left_semi")).distinct().groupBy("key").agg(F.count("*").alias("n"))
            counts = alone.union(together).groupBy("key").agg(F.sum("n").alias("n"))
    frequent = Table(counts.where(F.col("n") >= min_docs).select("key"), "frequent-lines").df
    if frequent.count() <= MOST_SENT:
        return _dropped_in_rows(docs, text_col, frequent, min_chars)
    held = own.select("id", "text_hash", F.posexplode("keys").alias("pos", "hex")).where("hex IS NOT NULL")
    held = held.withColumn("key", F.unhex("hex")).drop("hex").join(frequent, "key", "left_semi")
    told = held.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    rows = rows.join(told, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    rows = rows.select("row", "gone", _lines("text").alias("lines"))
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    between = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice("lines", F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1))
    out = rows.select("row", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(between)).alias("kept"), F.size("lines").cast("long").alias("n_lines"))
    return out.select("row", F.array_join("kept", "\n").alias("kept_text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


def op10_lines(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, row, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS row FROM documents)),
keyed AS (
  SELECT doc_id, row, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k
  FROM lines),
freq AS (SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT CASE WHEN doc_id IS NULL THEN 'row ' || row ELSE 'id ' || doc_id END) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(freq.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE freq.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN freq ON keyed.k = freq.k
GROUP BY doc_id, row
"""
