"""Steps around a language model. The model is a column function that a job passes in, such as an Arrow UDF.

A model is no pure function: write its answers to a table before they are used twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import history_lines, json_pairs, rewritten_or_original, strip, text_or_empty, without_thinking
from sievegrid.operators import mining
from sievegrid.sources.folders import new_path

Model = Callable[[Column], Column]
LEAST_TOKENS, MOST_TOKENS = 1024, 16_384


def output_budget(asked: int | None, default: int = 2048, least: int = LEAST_TOKENS) -> int:
    """Tokens to allow: thinking shares the budget with the answer, so small requests are raised."""
    return max(default if asked is None else asked, least)


def retry_budget(budget: int, most: int = MOST_TOKENS) -> int | None:
    """The budget of the one retry after a cut answer; None where it can't grow."""
    return min(3 * budget, most) if budget < most else None


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def answer_prompt(question: Column, context: Column) -> Column:
    return messages("Answer from the numbered sources alone and cite them as [n]; say so if they don't answer.", F.concat(F.lit("Sources:\n"), context, F.lit("\n\nQuestion: "), question))


def passage_prompt(question: Column) -> Column:
    return messages("Write a short passage, as a rulebook would, that answers the question.", question)


def rewrite_prompt(question: Column, history: Column) -> Column:
    return messages("Rewrite the last question so that it stands alone. Give the question only.", F.concat(history_lines(history), F.lit("\n\n"), question))


def mining_prompt(clause: Column) -> Column:
    return messages('Give up to two questions that the text answers, as JSON [{"question": "", "answer": ""}], answers word for word from the text.', clause)


def expanded(queries: DataFrame, models: list[Model]) -> DataFrame:
    """(query_id, text, variant): each question and the passages made for it; empty ones fall away, the question stays."""
    made = [strip(without_thinking(m(passage_prompt(F.col("text"))))) for m in models]
    texts = F.array(F.col("text"), *[F.nullif(text_or_empty(x), F.lit("")) for x in made])
    rows = queries.select("query_id", F.posexplode(texts).alias("variant", "text"))
    return rows.where("text IS NOT NULL").select("query_id", "text", "variant")


def with_history(questions: DataFrame, turns: DataFrame, last: int = 8) -> DataFrame:
    """(query_id, conv_id, turn, text) with the ``last`` turns before each, oldest first, as ``history`` of (role, text).

    Turns are (conv_id, turn, role, text), numbered one by one. They meet questions by conversation and number, so a long
    conversation is spread over all tasks; null numbers meet none, and a question without earlier turns has an empty history.
    """
    ahead = turns.select("conv_id", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + last)).alias("at"), F.struct("turn", "role", "text").alias("said"))
    asked = questions.select("query_id", "conv_id", F.col("turn").alias("at"))
    said = ahead.join(asked, ["conv_id", "at"]).groupBy("query_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    history = F.coalesce(F.transform("said", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))), F.array().cast("array<struct<role:string,text:string>>"))
    return questions.join(said, "query_id", "left").withColumn("history", history).drop("said")


def rewritten(queries: DataFrame, model: Model) -> DataFrame:
    """Questions of (query_id, text, history) made to stand alone; without history, or with a useless answer, as they were."""
    answer = rewritten_or_original(model(rewrite_prompt(F.col("text"), F.col("history"))), F.col("text"))
    return queries.withColumn("text", F.when(F.coalesce(F.size("history"), F.lit(0)) > 0, answer).otherwise(F.col("text")))


def mined_pairs(parents: DataFrame, model: Model, least: int = 60, most: int = 1500, each: int = 2) -> DataFrame:
    """(parent_id, question, answer, outcome) of the first questions that a model finds in each text of fitting length."""
    asked = parents.where(F.char_length("text").between(least, most)).select("parent_id", "text", json_pairs(without_thinking(model(mining_prompt(F.col("text"))))).alias("pairs"))
    rows = asked.select("parent_id", "text", F.explode(F.slice("pairs", 1, each)).alias("pair"))
    rows = rows.select("parent_id", "text", strip(F.col("pair.question")).alias("question"), strip(F.col("pair.answer")).alias("answer"))
    return mining.grounded(rows, "answer", "text").select("parent_id", "question", "answer", "outcome")


def reworded(pairs: DataFrame, model: Model, corpus: DataFrame) -> DataFrame:
    """Pairs with the question in a model's words, its id marked; those that stand in the corpus word for word go.

    Answers are written once: the search for leaks reads them several times, and each would ask the model and draw the pairs anew.
    """
    made = rewritten_or_original(model(messages("Ask the same in other words.", F.col("question"))), F.col("question"))
    rows = pairs.withColumn("question", made).withColumn("qa_id", F.concat("qa_id", F.lit("_pp")))
    path = new_path(pairs.sparkSession, "reworded")
    rows.write.parquet(path)
    rows = pairs.sparkSession.read.parquet(path)
    leaked = mining.leaks(rows.select(F.col("qa_id").alias("query_id"), F.col("question").alias("text")), corpus)
    return rows.join(leaked.withColumnRenamed("query_id", "qa_id"), "qa_id", "left_anti")
