"""A built-in embedder: sentences as signed hashed counts of their words and of the letters in them.

The engine splits and hashes; a task adds the counts up and compares neighbours, so that only hashes and distances travel.
Counts are whole numbers, so results don't depend on order. A model's vectors can stand in for it: what splits texts
takes a column of distances, wherever it comes from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from sievegrid.functions.text import HAN, sentences, words

DIM = 256
DIGITS = 9


def features(sentence: Column) -> Column:
    """Words of a sentence and, as Han texts have no blanks, its pairs of Han characters."""
    return F.concat(words(sentence), F.regexp_extract_all(sentence, F.lit(f"(?=({HAN}{{2}}))"), F.lit(1)))


def hashes(parts: Column) -> Column:
    """The hashed features of each sentence."""
    return F.transform(parts, lambda s: F.transform(features(s), lambda w: F.xxhash64(w)))


def vectors(hashed: list[np.ndarray], dim: int = DIM) -> np.ndarray:
    """A row of signed counts for each sentence: a hash names a component, and its highest bit the sign."""
    flat = np.concatenate([np.zeros(0, np.int64), *hashed]).astype(np.int64)
    row = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
    cell = row * dim + (flat & 0x7FFFFFFF) % dim
    return np.bincount(cell, weights=np.where(flat < 0, -1.0, 1.0), minlength=len(hashed) * dim).reshape(-1, dim)


def neighbour_distances(rows: np.ndarray) -> np.ndarray:
    """One less the cosine of each vector and the next; vectors without length are at distance 1 from all."""
    squares = (rows * rows).sum(axis=1)
    dots = (rows[:-1] * rows[1:]).sum(axis=1)
    return np.round(1 - dots / np.maximum(np.sqrt(squares[:-1] * squares[1:]), 1e-12), DIGITS)


@arrow_udf(ArrayType(DoubleType()))
def _distances(hashed: pa.Array) -> pa.Array:
    out = []
    for text in hashed:
        own = [] if not text.is_valid else [np.asarray(s.values) for s in text.values] if len(text) else []
        out.append(neighbour_distances(vectors(own)).tolist() if len(own) > 1 else [])
    return pa.array(out, pa.list_(pa.float64()))


def with_distances(rows: DataFrame, text_col: str = "text", name: str = "distances") -> DataFrame:
    """The given columns and the distances between neighbouring sentences of each text; a null or empty text has none."""
    return rows.withColumn(name, _distances(hashes(sentences(F.col(text_col)))))
