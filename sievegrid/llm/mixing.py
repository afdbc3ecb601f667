"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The leaves of a tree (here domain, language, source) hold tokens. The total budget is handed down the tree:
a parent's budget is shared among its children by weight, no child gets more than its whole subtree holds over
``epochs`` passes, and what a child can't use goes to its siblings by their weights; a parent that can't use its own
budget has already been held to what it holds, so what is left over there went to its siblings one level up.
Weights and budgets are whole numbers and a share is rounded down, so each level may leave up to a token for each child
unused. A leaf of budget b and supply s takes b div s
whole epochs and, of the next epoch in its seeded order, the shortest prefix of at least b mod s tokens.

The order of an epoch is that of a hash of seed, epoch and id. Leaves are cut by the hash's first digits
into parts whose token sums are pre-aggregated; only the part in which a prefix ends is ordered row by row. The number
of digits follows the leaf's rows, so that there are about as many parts as rows in a part (some 10^5 of each for 10^10
rows): no leaf is gathered in one task, however large its share of the rows.

Defined results: a token is a run of characters without ASCII white space; null and empty texts have no tokens and
come along where their place in the order lies within the prefix; a null level is a leaf of its own, named
``(none)``; null ids take part (rows that share an id are ordered by tokens and text hash); repeated rows are
separate rows; an empty table gives an empty result; the given columns come back inside a struct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.llm.shared import Table, read_table

SEED = 17
#: Of the tokens of all documents, in thousandths.
SHARE = 800
EPOCHS = 2
LEVELS = ("domain", "language", "origin")
#: Weights by level and name; names that aren't listed weigh 1.
WEIGHTS = {"domain": {"crawl": 3, "forum": 4, "library": 3}, "language": {"en": 5, "fr": 2, "de": 2, "es": 1}}
NONE = "(none)"


def document_levels() -> list[Column]:
    """The tree of ``documents``: numbered sources belong to three domains."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT)")
    domain = F.when(number == 0, "crawl").when(number < 10, "forum").when(number >= 10, "library")
    return [F.coalesce(x, F.lit(NONE)).alias(name) for name, x in zip(LEVELS, (domain, F.col("lang"), F.col("source")))]


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level, {}).items()
    return reduce(lambda x, kv: F.when(F.col(level) == kv[0], F.lit(kv[1])).otherwise(x), named, F.lit(1)).cast("long")


def _share_out(parents: DataFrame, children: DataFrame, above: list[str], name: str) -> DataFrame:
    """Children with a budget: full ones get all they hold, the others share the rest by weight."""
    family = W.partitionBy(*above) if above else W.partitionBy(F.lit(0))
    rising = family.orderBy(F.col("holds") / F.col("weight"), name)
    both = children.join(parents, above) if above else children.withColumn("parent_budget", parents.scalar())
    before = F.col("parent_budget") - (F.sum("holds").over(rising.rowsBetween(W.unboundedPreceding, 0)) - F.col("holds"))
    weight_from = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    both = both.withColumn("full", F.col("holds") * weight_from <= before * F.col("weight"))
    rest = F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("holds"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    share = F.expr("CASE WHEN full THEN holds ELSE (rest * weight) DIV open_weight END")
    both = both.withColumn("rest", rest).withColumn("open_weight", open_weight)
    return both.select(*above, name, share.alias("parent_budget"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: int, epochs: int) -> DataFrame:
    """(levels, supply, budget) from (levels, supply), one row per leaf of the tree."""
    budgets = leaves.agg((F.coalesce(F.sum("supply"), F.lit(0)) * share).alias("t")).select(F.expr("t DIV 1000").alias("parent_budget"))
    for depth, name in enumerate(levels):
        above = levels[:depth]
        nodes = leaves.groupBy(*above, name).agg((F.sum("supply") * epochs).alias("holds")).withColumn("weight", _weight(name, weights))
        budgets = _share_out(budgets, nodes, above, name)
    return leaves.join(budgets.withColumnRenamed("parent_budget", "budget"), levels)


def mix(docs: DataFrame, levels: list[Column], names: list[str], weights: dict[str, dict[str, int]], id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(row, levels, tokens, epoch): the chosen rows of ``docs``, once for each epoch that takes them."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")

    def order(id_: Column, epoch: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))

    sized = Table(docs.select(F.col(id_col).alias("id"), *levels, tokens.alias("tokens")), "mix-sizes").df
    digits = F.greatest(F.lit(1), F.ceil(F.log(F.count("*")) / F.log(F.lit(256.0)))).cast("int")
    leaves = Table(sized.groupBy(*names).agg(F.sum("tokens").alias("supply"), digits.alias("digits")), "mix-leaves").df
    budgets = leaf_budgets(leaves, names, weights, share, epochs)
    budgets = budgets.select(*names, "digits", F.expr("CASE WHEN supply > 0 THEN budget DIV supply ELSE 0 END").alias("whole"), F.expr("CASE WHEN supply > 0 THEN budget % supply ELSE 0 END").alias("wanted"))
    budgets = Table(budgets, "mix-budgets").df

    part = F.substring(order(F.col("id"), F.col("whole")), F.lit(1), F.col("digits"))
    parts = sized.join(budgets, names).groupBy(*names, "digits", "whole", "wanted", part.alias("part")).agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*names).orderBy("part"))
    ends = parts.withColumn("upto", upto).where(F.col("upto") >= F.col("wanted")).groupBy(*names, "digits", "whole", "wanted")
    ends = ends.agg(F.min_by(F.struct("part", (F.col("upto") - F.col("n")).alias("before")), "part").alias("end"))
    ends = Table(ends.select(*names, "digits", "whole", "wanted", F.col("end.part").alias("end"), F.col("end.before").alias("before")), "mix-ends").df

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *levels, tokens.alias("tokens"))
    rows = rows.join(ends, names).withColumn("key", order(F.col("id"), F.col("whole"))).withColumn("part", F.substring("key", F.lit(1), F.col("digits")))
    clear = rows.withColumn("last", F.when((F.col("part") < F.col("end")) & (F.col("wanted") > 0), F.col("whole")).otherwise(F.col("whole") - 1)).where("last >= 0")
    clear = clear.select("row", *names, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("epoch"))
    edge = rows.where("part = end AND wanted > 0")
    lead = F.sum("tokens").over(W.partitionBy(*names).orderBy("key", "tokens", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    edge = edge.withColumn("lead", F.col("before") + lead).where("lead < wanted").select("row", *names, "tokens", F.col("whole").alias("epoch"))
    return clear.union(edge)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix(docs, document_levels(), list(LEVELS), WEIGHTS)
    return out.select(F.col("row.doc_id").alias("doc_id"), *LEVELS, "tokens", "epoch")


def _sql_level(parent: str, child: str, above: list[str], name: str) -> str:
    """SQL of one level of budgets: ``child`` (above, name, holds, weight) under ``parent`` (above, budget)."""
    keys = "".join(f"{x}, " for x in above)
    join = " AND ".join(f"c.{x} = p.{x}" for x in above) or "true"
    part = "PARTITION BY " + (", ".join(f"c.{x}" for x in above) or "0")
    own = "PARTITION BY " + (", ".join(above) or "0")
    order = f"ORDER BY c.holds::double / c.weight, c.{name}"
    return f"""
    SELECT {keys}{name}, (CASE WHEN is_full THEN holds ELSE ((budget - full_holds) * weight) // open_weight END)::bigint AS budget FROM (
      SELECT *, coalesce(sum(CASE WHEN is_full THEN holds END) OVER ({own}), 0) AS full_holds,
             sum(CASE WHEN NOT is_full THEN weight END) OVER ({own}) AS open_weight FROM (
        SELECT {"".join(f"c.{x}, " for x in above)}c.{name}, c.holds, c.weight, p.budget,
               c.holds * sum(c.weight) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
               <= (p.budget - (sum(c.holds) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c.holds)) * c.weight AS is_full
        FROM ({child}) c JOIN ({parent}) p ON {join}))"""


def _sql() -> str:
    def cases(level: str) -> str:
        return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items()) + " ELSE 1 END" if level in WEIGHTS else "1"

    budget = f"SELECT (coalesce(sum(tokens), 0) * {SHARE}) // 1000 AS budget FROM sized"
    for depth, name in enumerate(LEVELS):
        above = list(LEVELS[:depth])
        child = f"SELECT {''.join(f'{x}, ' for x in above)}{name}, sum(tokens) * {EPOCHS} AS holds, {cases(name)} AS weight FROM sized GROUP BY ALL"
        budget = _sql_level(budget, child, above, name)
    keys = ", ".join(LEVELS)
    return f"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS tokens,
         CASE WHEN n = 0 THEN 'crawl' WHEN n < 10 THEN 'forum' WHEN n >= 10 THEN 'library' ELSE '{NONE}' END AS domain,
         coalesce(lang, '{NONE}') AS language, coalesce(source, '{NONE}') AS origin
  FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS integer) AS n FROM documents)),
budgets AS ({budget}),
leaves AS (
  SELECT {keys}, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS wanted
  FROM budgets JOIN (SELECT {keys}, sum(tokens)::bigint AS supply FROM sized GROUP BY ALL) USING ({keys})),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY {keys} ORDER BY md5('{SEED}|' || whole || '|' || doc_id), tokens
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS before
  FROM sized JOIN leaves USING ({keys}))
SELECT doc_id, {keys}, tokens, unnest(range(0, whole + CASE WHEN before < wanted THEN 1 ELSE 0 END)) AS epoch FROM placed
"""


SQL = _sql()
