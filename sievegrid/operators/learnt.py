"""A learnt second stage: a linear score over what a question and a candidate share, fitted by InfoNCE over groups.

A group is a question with its right answer and the other merged candidates as hard negatives (``fusion.KEEP`` at most, so a
group is one bounded row). The loss is that of choosing the right one by softmax. Each round is one pass: tasks give the sums of
gradient and curvature over their groups, an aggregation adds them, and the driver takes one Newton step of seven numbers.
All training groups count in every round; the written table of features is read again, texts are not.

Null texts and questions are empty ones, null scores 0. A question without its right answer among the candidates, or without any other
candidate, teaches nothing. With no groups at all the weights stay at their start, which ranks as ``rerank.overlap`` does. Of several
rows marked right in a group each counts as an equal share. Sums are of doubles, so weights are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import words
from sievegrid.operators import rerank
from sievegrid.sources.folders import new_path

#: overlap, share of neighbouring words, merged score, its rank, length of the text, share of the text that is asked for, share of letters in threes
FEATURES = 7
START = [1.0] + [0.0] * (FEATURES - 1)
ROUNDS, RIDGE, DIGITS = 8, 0.01, 6


def _share(wanted: Column, held: Column) -> Column:
    wanted = F.array_distinct(wanted)
    return F.size(F.array_intersect(wanted, held)) / F.greatest(F.size(wanted), F.lit(1))


def _pairs(found: Column) -> Column:
    after = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), after, lambda a, b: F.concat_ws(" ", a, b))


def _threes(text: Column) -> Column:
    """Runs of three letters or digits at the start of each word."""
    return F.transform(words(text), lambda w: F.substring(w, 1, 3))


def features(query: Column, text: Column, score: Column, rank: Column) -> Column:
    """Seven numbers of about the same size for a question and a candidate."""
    asked, held = words(query), words(text)
    many = F.size(held)
    return F.array(
        rerank.overlap(query, text) / 6,
        _share(_pairs(asked), _pairs(held)),
        F.coalesce(score, F.lit(0.0)).cast("double"),
        1 / F.sqrt(F.greatest(F.coalesce(rank, F.lit(1)), F.lit(1)).cast("double")),
        F.log1p(many.cast("double")) / 5,
        F.size(F.array_intersect(F.array_distinct(asked), held)) / F.greatest(many, F.lit(1)),
        _share(_threes(query), _threes(text)),
    )


def groups(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, x, y) of the questions that teach, from ``pool`` (query_id, query, child_id, text, score, ord) and ``gold`` (query_id, gold)."""
    right = gold.where("gold IS NOT NULL").select("query_id", F.col("gold").alias("child_id"), F.lit(1.0).alias("y")).distinct()
    rows = pool.join(right.select("query_id").distinct(), "query_id", "left_semi").join(right, ["query_id", "child_id"], "left")
    x = features(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit("")), F.col("score"), F.col("ord"))
    rows = rows.select("query_id", "child_id", F.coalesce("y", F.lit(0.0)).alias("y"), x.alias("x"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("child_id", "x", "y"))).alias("c"))
    out = listed.select("query_id", F.transform("c", lambda c: c["x"]).alias("x"), F.transform("c", lambda c: c["y"]).alias("y"))
    return out.where((F.size("y") > 1) & F.exists("y", lambda y: y > 0))


def _sums(batches: Iterator[pd.DataFrame], weights: list[float]) -> Iterator[pd.DataFrame]:
    """Loss, gradient and curvature over the groups of a task, one row of numbers for each place."""
    total = np.zeros(1 + FEATURES + FEATURES**2)
    for batch in batches:
        for xs, ys in zip(batch["x"], batch["y"]):
            x, y = np.stack(list(xs)), np.asarray(ys) / np.sum(ys)
            logits = x @ np.asarray(weights)
            p = np.exp(logits - logits.max())
            p /= p.sum()
            mean = p @ x
            total[0] -= np.log(np.maximum(p[y > 0], 1e-300)) @ y[y > 0]
            total[1 : 1 + FEATURES] += mean - y @ x
            total[1 + FEATURES :] += ((x * p[:, None]).T @ x - np.outer(mean, mean)).ravel()
    yield pd.DataFrame({"place": np.arange(len(total)), "part": total})


def train(pool: DataFrame, gold: DataFrame, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[list[float], list[float]]:
    """Weights, and the loss before each round (a mean over groups, without the ridge that pulls weights to 0)."""
    spark = pool.sparkSession
    path = new_path(spark, "rerank-groups")
    groups(pool, gold).write.parquet(path)
    table = spark.read.parquet(path)
    n, weights, losses = table.count(), list(START), []
    for _ in range(rounds if n else 0):
        now = list(weights)
        parts = table.select("x", "y").mapInPandas(lambda batches: _sums(batches, now), "place long, part double")  # noqa: B023  used before the next round
        sums = np.array([r.total for r in parts.groupBy("place").agg(F.sum("part").alias("total")).orderBy("place").collect()]) / n
        losses.append(round(float(sums[0]), DIGITS))
        gradient = sums[1 : 1 + FEATURES] + ridge * np.asarray(weights)
        curvature = sums[1 + FEATURES :].reshape(FEATURES, FEATURES) + ridge * np.eye(FEATURES)
        step = np.linalg.solve(curvature, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))  # far from the optimum a whole step may overshoot
        weights = [round(float(w), DIGITS) for w in np.asarray(weights) - step]
    return weights, losses


def scorer(weights: list[float]) -> rerank.Scorer:
    """For ``rerank.rerank``, whose rows bring the merged score and rank."""

    def score(query: Column, text: Column) -> Column:
        x = features(F.coalesce(query, F.lit("")), F.coalesce(text, F.lit("")), F.col("fused_score"), F.col("fused_rank"))
        products = F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, w: a * w)
        return F.round(F.aggregate(products, F.lit(0.0), lambda a, b: a + b), DIGITS)

    return score
