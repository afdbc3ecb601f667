"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A text is cut into runs of letters, of digits and of other visible characters. Each run and each pair of
neighbours is hashed to one of ``2 ** BITS`` features; all pairs of equal neighbours share one feature, and so do
all runs that return after one other, so repetition is seen whatever is repeated. A text's counts are scaled to
length one, and its score is the logistic function of a sparse dot product with the weights. One task trains the
weights on at most ``SAMPLE`` labelled ids whose texts have ``SAMPLE_FEATURES`` features at most together, in the order of a
hash of the id; scoring is one pass over the whole texts without a shuffle.

Defined results: null and empty texts have the bias alone as their score; without labels, or with one class only,
the weights are what those rows give (none: a score of 0.5); null ids are scored, are never held out and never
train; repeated rows are each scored; an empty table gives an empty result; other columns come along, but for one that
has the score's name, which is replaced. A task holds the runs of one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.llm.shared import Table, read_table

BITS = 18
#: The largest number of labelled rows that training reads, those of the smallest hash of their id.
SAMPLE = 8_000
#: Features of all training texts together, 8 bytes each: this bounds the training task by memory.
SAMPLE_FEATURES = 16_000_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3
_RUN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of the whole text and their values; feature 0 is the bias, with value 1."""
    runs = _RUN.findall((text or "").encode("utf-8", "surrogatepass"))
    words = np.fromiter(map(crc32, runs), dtype=np.uint64, count=len(runs))
    left, right = words[:-1], words[1:]
    pairs = np.where(left == right, np.uint64(1), (left * np.uint64(0x9E3779B97F4A7C15) ^ right) * np.uint64(0xC2B2AE3D27D4EB4F))
    again = np.full(np.count_nonzero(words[:-2] == words[2:]), 2, dtype=np.uint64)
    hashes = np.concatenate([words * np.uint64(0xFF51AFD7ED558CCD), pairs, again])
    grams = np.where(hashes > 2, hashes >> np.uint64(64 - bits), hashes)
    number, count = np.unique(grams, return_counts=True)
    number = np.concatenate([[0], number[number > 0].astype(np.int64)])
    value = np.concatenate([[0.0], count[-(len(number) - 1) :].astype(np.float64)]) if len(number) > 1 else np.zeros(1)
    norm = np.sqrt((value * value).sum())
    value = value / norm if norm else value
    value[0] = 1.0
    return number, value


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, number: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(number)
        grad = (sigmoid(w @ value) - label) * value
        n = self.n[number]
        self.z[number] += grad - (np.sqrt(n + grad * grad) - np.sqrt(n)) / ALPHA * w
        self.n[number] = n + grad * grad


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights from labelled rows outside the held-out fold, as one array of ``2 ** bits`` numbers on the driver."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [features(text.as_py(), bits) for text in batch.column(2)]
            columns = [pa.array([x[0] for x in each], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in each], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["order", "label", "number", "value"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("label", "ascending")])
        labels = table.column("label").to_pylist()
        number, value = ([x.values.to_numpy() for x in table.column(c)] for c in ("number", "value"))
        model = Ftrl(1 << bits)
        for _ in range(EPOCHS):
            for at, x, label in zip(number, value, labels):
                model.update(at, x, label)
        w = model.weights()
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array([at.tolist()], pa.list_(pa.int64())), "w": pa.array([w[at].tolist()], pa.list_(pa.float64()))})

    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(f"id IS NOT NULL AND label IN (0, 1) AND crc32(CAST(id AS STRING)) % {folds} <> 0")
    usable = usable.withColumn("order", F.md5(F.concat(F.lit("quality-"), F.col("id").cast("string")).cast("binary"))).orderBy("order", "label").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(usable), "id").select("order", "label", "text")  # at most ``sample`` small rows are sent
    rows = Table(rows.mapInArrow(featurise, "order string, label int, number array<int>, value array<float>"), "quality-features")
    held = F.sum(F.size("number")).over(W.orderBy("order"))  # over the sample; rows of one id come and go together
    last = rows.df.select("order", held.alias("held")).where(F.col("held") <= SAMPLE_FEATURES).agg(F.max("order")).first()[0]
    weights = np.zeros(1 << bits)
    for x in rows.df.where(F.col("order") <= last).withColumn("all", F.lit(1)).groupBy("all").applyInArrow(fit, "at array<long>, w array<double>").collect():
        weights[np.array(x.at, dtype=np.int64)] = x.w
    rows.drop()
    return weights


def add_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of the whole text as one more column, last."""
    docs = docs.drop(name)
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    bits, at = len(weights).bit_length() - 1, docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(at)):
                number, value = features(text.as_py(), bits)
                scores[i] = sigmoid(w[number] @ value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    schema = docs.select(*docs.columns).withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(each, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return add_score(docs, weights, name="score").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
