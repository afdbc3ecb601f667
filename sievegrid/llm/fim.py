"""Fill-in-middle: a document is cut in three and its parts change places, so that a model learns to fill gaps.

A document's units are the matches of one pattern, words with the blanks before them. The ``tokenizers`` library's Split
pre-tokenizer isolates them, without any training, and gives their offsets in code points: as many offsets as
units, and the offsets at two seeded ranks are the cuts. Where a document is cut and in which form it is written follow from a
hash of the seed and its id alone, so the result doesn't depend on partitioning.

A document is a row that is handled on its own: nothing is shuffled. Long texts are pre-tokenized in stretches that end
where a unit ends, so a task holds one text and the offsets of its units.

Defined results: null and empty texts have no units and stay plain (empty); a text that contains one of the marks stays
plain, as it couldn't be restored; equal rows give equal results; a null id is hashed as an empty one; ties, where both
cuts fall together, give an empty middle; an empty table gives an empty result; other columns come along untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from sievegrid.llm.shared import read_table

SEED = 42
#: Of a hundred documents, how many are cut; of a hundred that are cut, how many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK = r"\x20\x09-\x0D"
#: Blanks and the word behind them, or blanks at the end. No match ever gives back what it took, so long runs of blanks are no trouble.
UNIT = rf"[{_BLANK}]*+[^{_BLANK}]++|[{_BLANK}]++"
_UNIT_END = re.compile(rf"[^{_BLANK}](?=[{_BLANK}])")
STRETCH = 1 << 20
_AT_ONCE = 256


def splitter() -> Split:
    return Split(Regex(UNIT), behavior="isolated")


def unit_ends(text: str, split: Split, stretch: int = STRETCH) -> np.ndarray:
    """Where each unit of a text ends, in code points."""
    ends, start = [np.zeros(0, dtype=np.int64)], 0
    while start < len(text):
        stop = _UNIT_END.search(text, start + stretch) if len(text) - start > stretch else None
        stop = stop.end() if stop else len(text)
        units = split.pre_tokenize_str(text[start:stop])
        ends.append(np.fromiter((span[1] for _, span in units), dtype=np.int64, count=len(units)) + start)
        start = stop
    return np.concatenate(ends)


def transformed(text: str, name: str, split: Split, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of a text; ``name`` is its id in decimal."""
    ends = unit_ends(text, split)
    n = len(ends)
    digest = sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = (int(ends[cut - 1]) if cut else 0 for cut in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < suffix_first:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, carry: list[str] | None = None) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): ``row`` is a struct of the ``carry`` columns, all by default."""
    carry = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), docs[id_col].cast("string").alias("name"), docs[text_col].alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for part in (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE)):
            out = [transformed(text.as_py() or "", name.as_py() or "", split, seed, rate, suffix_first) for name, text in zip(part.column(1), part.column(2))]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*out), kinds))], names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    kinds = StructType([rows.schema["row"], *StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")])
    return rows.mapInArrow(each, kinds)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks can't come about where parts meet, so the first one of each kind is the real one."""

    def after(x: Column, mark: str) -> Column:
        return F.substring(x, F.locate(mark, x) + len(mark), F.char_length(x))

    second = F.when(form == "psm", F.substring_index(after(output, PREFIX), SUFFIX, 1)).otherwise(F.substring_index(after(output, PREFIX), MIDDLE, 1))
    suffix = F.when(form == "psm", F.substring_index(after(output, SUFFIX), MIDDLE, 1)).otherwise(F.substring_index(after(output, SUFFIX), PREFIX, 1))
    return F.when(form == "plain", output).otherwise(F.concat(second, after(output, MIDDLE), suffix))


def op13_fim(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle(docs, carry=["doc_id"])
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def _hash_sql(group: int) -> str:
    return f"('0x' || digest[{8 * group + 1}:{8 * group + 8}])::ubigint"


SQL = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+') AS u
  FROM documents),
cuts AS (
  SELECT *, len(u) AS n, {_hash_sql(0)} % (len(u) + 1) AS x, {_hash_sql(1)} % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_hash_sql(2)} % 100 >= {RATE} THEN 'plain'
      WHEN {_hash_sql(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(x, y)::bigint], '') AS p, array_to_string(u[least(x, y)::bigint + 1:greatest(x, y)::bigint], '') AS m,
    array_to_string(u[greatest(x, y)::bigint + 1:], '') AS s
  FROM cuts)
SELECT doc_id, n::bigint AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
