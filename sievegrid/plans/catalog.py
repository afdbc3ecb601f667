"""The registered queries over the driver tables and, where SQL can express them, the same queries in SQL.

Benchmark passages are the questions; documents are children whose parent is their source. A question's vector is
the embedding of the same number, and a document's vector likewise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.functions import text as tx
from sievegrid.functions.vectors import sparse_dot
from sievegrid.operators import ann, bm25, chunking, containment, context, dedup, dense, embedding, evaluation, fusion, keyword, learnt, mining, profile, rerank, segment, where
from sievegrid.plans import search
from sievegrid.sources import content, html
from sievegrid.sources.folders import new_path, spread
from sievegrid.sources.manifest_log import ManifestLog
from sievegrid.sources.store import Store
from sievegrid.streaming import events as streams
from sievegrid.streaming import memory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("child_id"), F.col("source").alias("parent_id"), "text", "lang")
    return spread(rows, "child_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), "embedding")


def _bm25(spark, sf_dir, k=50):
    return bm25.search(bm25.build(children(spark, sf_dir)), questions(spark, sf_dir), k)


def _dense(spark, sf_dir, k=50):
    asked = questions(spark, sf_dir).select("query_id")
    held = children(spark, sf_dir).select("child_id")
    return dense.knn(vectors(spark, sf_dir, "query_id").join(asked, "query_id", "left_semi"), vectors(spark, sf_dir, "child_id").join(held, "child_id", "left_semi"), k)


def _channels(spark, sf_dir):
    return {"bm25": _bm25(spark, sf_dir), "dense": _dense(spark, sf_dir)}


# --- SQL of the shared parts -------------------------------------------------------------------------------------
BM25_SQL = """
tok AS (SELECT doc_id, CASE WHEN len(t) > 0 THEN t ELSE ['　'] END AS t FROM (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS t FROM documents)),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
dl AS (SELECT doc_id, len(t) AS dl FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, ln((SELECT count(*) FROM tok) - df + 0.5) - ln(df + 0.5) AS idf FROM df),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qt AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id AS query_id, doc_id AS child_id,
    round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS ord FROM scored WHERE score > 0) WHERE ord <= 50)"""

DENSE_SQL = """
dv AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS ord FROM (
  SELECT q.vec_id AS query_id, d.vec_id AS child_id, round(list_cosine_similarity(q.v, d.v), 6) AS score
  FROM dv q JOIN benchmark b ON q.vec_id = b.item_id CROSS JOIN dv d JOIN documents c ON c.doc_id = d.vec_id)) WHERE ord <= 50)"""


#: Tables of each channel's hits in SQL.
CHANNEL_SQL = {"bm25": "bm", "dense": "den", "keyword": "kw"}


def fused_sql(alpha: float, channels: tuple[str, ...] = ("bm25", "dense"), name: str = "fused") -> str:
    weights = {c: fusion.WEIGHTS[c] for c in channels}
    rows = " UNION ALL ".join(f"SELECT query_id, '{c}' AS channel, {w} AS w, child_id, score, ord FROM {CHANNEL_SQL[c]}" for c, w in weights.items())
    return f"""
{name}_rows AS (SELECT *, max(score) OVER g - min(score) OVER g AS span, score - min(score) OVER g AS above FROM ({rows})
  WINDOW g AS (PARTITION BY query_id, channel)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS ord FROM (
  SELECT query_id, child_id,
    round(sum(w / {sum(weights.values())} * ({1 - alpha} / (60 + ord) + {alpha} * CASE WHEN span < 1e-12 THEN 1.0 ELSE above / span END)), 6) AS score
  FROM {name}_rows GROUP BY ALL)) WHERE ord <= 50)"""


PER_PARENT_SQL = """
per_parent AS (SELECT query_id, child_id, parent_id, score, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS ord FROM (
  SELECT f.*, d.source AS parent_id, row_number() OVER (PARTITION BY query_id, d.source ORDER BY ord) AS n
  FROM fused f JOIN documents d ON d.doc_id = f.child_id) WHERE n = 1)"""


# --- retrieval ---------------------------------------------------------------------------------------------------
@query(f"WITH {BM25_SQL} SELECT query_id, child_id, score, ord::integer AS ord FROM bm WHERE ord <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


@query(SQL["bm25_topk"])
def bm25_stored(spark, sf_dir):
    """The same from an index that was written once and reads the folders of the questions' terms alone."""
    path = new_path(spark, "text-index")
    bm25.store(children(spark, sf_dir), path)
    return bm25.search(bm25.load_stored(spark, path), questions(spark, sf_dir), 10)


@query("""
WITH v AS (SELECT vec_id, embedding::double[] AS v FROM embeddings)
SELECT query_id, child_id, score, ord::integer AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS ord FROM (
    SELECT q.vec_id AS query_id, d.vec_id AS child_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id))
WHERE ord <= 10""")
def knn_topk(spark, sf_dir):
    return dense.knn(vectors(spark, sf_dir, "query_id"), vectors(spark, sf_dir, "child_id"), 10, skip_same=True)


def _inverted_file(spark, sf_dir, recall):
    index = ann.build(vectors(spark, sf_dir, "child_id"), new_path(spark, "vector-index"), recall=recall)
    return ann.search(index, vectors(spark, sf_dir, "query_id"), 10, skip_same=True)


@query()
def ann_topk(spark, sf_dir):
    """As ``knn_topk`` from a stored index that visits a few cells; recall is measured against it in a test."""
    return _inverted_file(spark, sf_dir, ann.RECALL)


@query(SQL["knn_topk"])
def ann_exact(spark, sf_dir):
    """The same index with all cells visited: what the codes rule out is never among the best."""
    return _inverted_file(spark, sf_dir, 1.0)


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql(0.0)} SELECT query_id, child_id, score, ord::integer AS ord FROM fused")
def rrf_plain(spark, sf_dir):
    return fusion.fuse(_channels(spark, sf_dir), alpha=0.0).select("query_id", "child_id", "score", "ord")


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql(0.3)} SELECT query_id, child_id, score, ord::integer AS ord FROM fused")
def rrf_score(spark, sf_dir):
    return fusion.fuse(_channels(spark, sf_dir)).select("query_id", "child_id", "score", "ord")


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql(0.3)} SELECT query_id, channel, count(*) AS hits FROM fused JOIN fused_rows USING (query_id, child_id) GROUP BY ALL")
def channel_participation(spark, sf_dir):
    return fusion.participation(fusion.fuse(_channels(spark, sf_dir)))


def _per_parent(spark, sf_dir):
    merged = fusion.fuse(_channels(spark, sf_dir)).join(children(spark, sf_dir).select("child_id", "parent_id"), "child_id")
    return fusion.first_per_parent(merged)


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql(0.3)}, {PER_PARENT_SQL} SELECT query_id, child_id, parent_id, score, ord::integer AS ord FROM per_parent")
def dedupe_parent(spark, sf_dir):
    return _per_parent(spark, sf_dir).select("query_id", "child_id", "parent_id", "score", "ord")


@query(f"""
WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql(0.3)}, {PER_PARENT_SQL},
ex AS (SELECT item_id AS query_id, doc_id AS child_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
final AS (SELECT * FROM per_parent WHERE ord <= 5),
pinned AS (SELECT * FROM (SELECT p.query_id, p.child_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.child_id) AS n
  FROM per_parent p JOIN ex USING (query_id, child_id) WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.query_id = p.query_id AND f.child_id = p.child_id)) WHERE n <= 2)
SELECT query_id, child_id, pinned, ord::integer AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, n) AS ord FROM (
    SELECT query_id, child_id, true AS pinned, n FROM pinned UNION ALL SELECT query_id, child_id, false, ord FROM final)) WHERE ord <= 5""")
def pin_exact(spark, sf_dir):
    pool = _per_parent(spark, sf_dir)
    exact = theta_contains(spark, sf_dir).withColumn("ord", F.lit(1))
    return fusion.pin(pool.where("ord <= 5"), pool, exact, 5).select("query_id", "child_id", "pinned", "ord")


def _half(x, first: bool):
    n = F.floor(F.char_length(x) / 2).cast("int")
    return F.substring(x, F.lit(1), n) if first else F.substring(x, n + 1, F.char_length(x))


@query(f"""
WITH variants AS (SELECT item_id * 2 + v AS item_id, CASE WHEN v = 0 THEN text[:length(text) // 2] ELSE text[length(text) // 2 + 1:] END AS text FROM benchmark, (VALUES (0), (1)) t(v)),
{BM25_SQL.replace("FROM benchmark", "FROM variants")}
SELECT query_id, child_id, score, variant::integer AS variant FROM (
  SELECT query_id // 2 AS query_id, child_id, score, query_id % 2 AS variant, row_number() OVER (PARTITION BY query_id // 2, child_id ORDER BY score DESC, query_id % 2) AS n FROM bm) WHERE n = 1""")
def expand_max(spark, sf_dir):
    """Two wordings of each question, here its halves; a hit counts by its better score."""
    asked = questions(spark, sf_dir)
    both = asked.select((F.col("query_id") * 2).alias("query_id"), _half(F.col("text"), True).alias("text")).union(asked.select((F.col("query_id") * 2 + 1).alias("query_id"), _half(F.col("text"), False).alias("text")))
    hits = bm25.search(bm25.build(children(spark, sf_dir)), both, 50)
    hits = hits.select(F.floor(F.col("query_id") / 2).alias("query_id"), "child_id", "score", (F.col("query_id") % 2).cast("int").alias("variant"))
    return fusion.best_of_variants(hits)


@query()
def hybrid_search(spark, sf_dir):
    """The whole of it: both channels, fusion, one hit a parent, second-stage ranking and the final five."""
    kids = children(spark, sf_dir)
    out = search.search(questions(spark, sf_dir), kids, None, _channels(spark, sf_dir))
    return out.select("query_id", "ord", "child_id", "parent_id", "score", "fused_score", "fused_rank")


RERANK_SQL = f"""
WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql(0.3)}, {PER_PARENT_SQL},
words AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark),
rated AS (SELECT p.query_id, p.child_id, p.parent_id, p.score AS fused_score, p.ord AS fused_rank,
  round(12.0 * len(list_intersect(w, regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+'))) / greatest(len(w), 1) - 6, 6) AS score
  FROM per_parent p JOIN words ON item_id = query_id JOIN documents d ON d.doc_id = p.child_id),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS ord FROM rated)
"""
SQL["hybrid_search"] = RERANK_SQL + "SELECT query_id, ord::integer AS ord, child_id, parent_id, score, fused_score, fused_rank::integer AS fused_rank FROM final WHERE ord <= 5"


@query(RERANK_SQL + """
SELECT b.item_id AS query_id, CASE WHEN t.score IS NULL THEN 'low' WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS level,
  round(coalesce(p, 0.0), 4) AS probability, round(t.score - n.score, 4) AS margin, coalesce(round(t.score - n.score, 4) < 1, false) AS ambiguous, 0::bigint AS stale
FROM benchmark b LEFT JOIN (SELECT *, 1 / (1 + exp(-score)) AS p FROM final WHERE ord = 1) t ON t.query_id = b.item_id LEFT JOIN final n ON n.query_id = b.item_id AND n.ord = 2""")
def confidence(spark, sf_dir):
    hits = search.search(questions(spark, sf_dir), children(spark, sf_dir), None, _channels(spark, sf_dir))
    return context.confidence(hits.withColumn("effective_status", F.lit(tx.UNKNOWN)), questions(spark, sf_dir))


@query("""
SELECT item_id AS query_id, doc_id AS child_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def theta_contains(spark, sf_dir):
    return containment.containing(questions(spark, sf_dir), children(spark, sf_dir))


@query("SELECT item_id AS query_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')))")
def leak_check(spark, sf_dir):
    return mining.leaks(questions(spark, sf_dir), children(spark, sf_dir))


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def filter_status(spark, sf_dir):
    """What is known to be bad goes, what isn't known stays."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return keyword.not_repealed(rows.withColumn("status", F.when(F.col("toxic") == 1, tx.REPEALED)), "status").drop("status")


# --- Han texts ---------------------------------------------------------------------------------------------------
# The given texts hold no Han characters, so each letter is written as one, and blanks go: words have to be found again.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HAN_LETTERS = "的一是不了人在有我他这中大来上个国和也子学行能前市工"


def _han(texts: DataFrame, id_col: str) -> DataFrame:
    return texts.select(id_col, F.translate(F.lower("text"), LETTERS + " \n", HAN_LETTERS).alias("text"))


HAN_SQL = f"""
runs AS (SELECT unnest(regexp_extract_all(translate(lower(text), '{LETTERS} ' || chr(10), '{HAN_LETTERS}'), '{segment.HAN_RUN}')) AS run FROM documents),
once AS (SELECT run, count(*) AS times FROM runs GROUP BY run),
sub AS (SELECT run[i:i + k - 1] AS word, CASE WHEN i > 1 THEN run[i - 1:i - 1] ELSE '' END AS l, run[i + k:i + k] AS r, times
  FROM (SELECT run, times, unnest(range(1, length(run) + 1)) AS i FROM once) JOIN (SELECT unnest(range(1, {segment.LONGEST + 1})) AS k) ON i + k - 1 <= length(run)),
three AS (SELECT word, l, r, sum(times) AS n FROM sub GROUP BY ALL),
num AS (SELECT word, sum(n)::bigint AS n FROM three GROUP BY word),
tot AS (SELECT sum(n)::double AS t FROM num WHERE length(word) = 1),
half AS (SELECT word, n, left(word, cut::integer) AS a, substr(word, cut::integer + 1) AS b FROM (SELECT *, unnest(range(1, length(word))) AS cut FROM num WHERE length(word) > 1)),
coh AS (SELECT half.word, round(min(ln(half.n) + ln(t) - ln(x.n) - ln(y.n)), 6) AS cohesion FROM half JOIN num x ON x.word = a JOIN num y ON y.word = b, tot GROUP BY half.word),
lf AS (SELECT word, round(ln(sum(n)) - sum(CASE WHEN l <> '' THEN n * ln(n) ELSE 0 END) / sum(n), 6) AS e FROM (SELECT word, l, sum(n)::double AS n FROM three GROUP BY ALL) GROUP BY word),
rf AS (SELECT word, round(ln(sum(n)) - sum(CASE WHEN r <> '' THEN n * ln(n) ELSE 0 END) / sum(n), 6) AS e FROM (SELECT word, r, sum(n)::double AS n FROM three GROUP BY ALL) GROUP BY word)"""


@query(f"""
WITH {HAN_SQL}
SELECT word, num.n, cohesion, least(lf.e, rf.e) AS freedom FROM num LEFT JOIN coh USING (word) JOIN lf USING (word) JOIN rf USING (word)
WHERE length(word) = 1 OR (num.n >= {segment.LEAST_COUNT} AND cohesion >= {segment.COHESION} AND least(lf.e, rf.e) >= {segment.FREEDOM})""")
def cjk_dictionary(spark, sf_dir):
    """Characters and learnt words of the texts, with what makes them words."""
    found = segment.statistics(_han(children(spark, sf_dir), "child_id"))
    return found.join(segment.dictionary(found).select("word"), "word", "left_semi").select("word", "n", "cohesion", "freedom")


def _han_words(spark, sf_dir):
    """The dictionary as a table, as every search reads it several times."""
    path = new_path(spark, "han-dictionary")
    segment.dictionary(segment.statistics(_han(children(spark, sf_dir), "child_id"))).write.parquet(path)
    return spark.read.parquet(path)


@query()
def cjk_words(spark, sf_dir):
    """Words of each document's Han runs with their places."""
    return segment.tokens(_han(children(spark, sf_dir), "child_id"), _han_words(spark, sf_dir))


@query()
def cjk_topk(spark, sf_dir):
    """BM25 over the words of Han texts; documents and questions are split by the same dictionary."""
    words, kids = _han_words(spark, sf_dir), _han(children(spark, sf_dir), "child_id")
    asked = segment.tokens(_han(questions(spark, sf_dir), "query_id"), words, "query_id")
    asked = asked.groupBy(F.col("id").alias("query_id"), "term").agg(F.count("*").alias("times"))
    path = new_path(spark, "han-terms")
    segment.term_lists(kids, words).write.parquet(path)  # read to be counted, then to be scored
    return bm25.search_lists(spark.read.parquet(path), asked, 10).select("query_id", "child_id", "score", "ord")


# --- tables ------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_incremental(spark, sf_dir):
    return dedup.to_add(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, 'new' AS state FROM documents UNION ALL SELECT doc_id, 'old' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.lit("old").alias("state"))
    return dedup.upsert(old, table(spark, sf_dir, "documents").select("doc_id", F.lit("new").alias("state")), ["doc_id"])


@query("""
SELECT o_custkey AS key, max(o_totalprice) AS price, 'order' AS state FROM orders GROUP BY ALL
UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def store_upsert(spark, sf_dir):
    """A store of customers in which each one's dearest order takes the customer's place."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("price"), F.lit("customer").alias("state"))
    store = Store.create(old, new_path(spark, "keyed-store"), "key", 32)
    store.upsert(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("price"), F.lit("order").alias("state")))
    return store.rows()


@query("SELECT vec_id AS key, label FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def store_lookup(spark, sf_dir):
    """The stored rows of the questions' numbers, read from the buckets of these alone."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")
    store = Store.create(held, new_path(spark, "keyed-store"), "key", 64)
    return store.lookup(questions(spark, sf_dir).select(F.col("query_id").alias("key"))).select("key", "label")


#: A tree for each part of the filter language, by name.
TREES = {
    "eq": {"lang": "en"},
    "ne": {"lang": {"$ne": "en"}},
    "in": {"lang": {"$in": ["de", "fr"]}},
    "nin": {"lang": {"$nin": ["de", "fr"]}},
    "range": {"n_chars": {"$gte": 500, "$lt": 1000}},
    "and": {"$and": [{"lang": "es"}, {"n_chars": {"$gt": 700}}]},
    "or": {"$or": [{"lang": "es"}, {"$and": [{"n_chars": {"$lte": 300}}, {"lang": {"$ne": "fr"}}]}]},
}


@query("""
SELECT 'eq' AS tree, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'ne', doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'
UNION ALL SELECT 'in', doc_id FROM documents WHERE lang IN ('de', 'fr') UNION ALL SELECT 'nin', doc_id FROM documents WHERE coalesce(lang NOT IN ('de', 'fr'), true)
UNION ALL SELECT 'range', doc_id FROM documents WHERE n_chars >= 500 AND n_chars < 1000 UNION ALL SELECT 'and', doc_id FROM documents WHERE lang = 'es' AND n_chars > 700
UNION ALL SELECT 'or', doc_id FROM documents WHERE lang = 'es' OR (n_chars <= 300 AND lang IS DISTINCT FROM 'fr')""")
def filter_trees(spark, sf_dir):
    """Documents that each tree of the filter language takes."""
    taken = [table(spark, sf_dir, "documents").where(where.condition(tree)).select(F.lit(name).alias("tree"), "doc_id") for name, tree in TREES.items()]
    return reduce(DataFrame.unionAll, taken)


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return dedup.last_good(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error").drop("ts")


@query("""
SELECT id, status, local_path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, local_path DESC) AS n FROM (
  SELECT user_id AS id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || '/' || event_id END AS local_path FROM events) WHERE status <> 'failed' AND local_path <> '') WHERE n = 1""")
def manifest_log(spark, sf_dir):
    """Events as attempts at fetching, in three batches by date; the first two are compacted, the second comes twice."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("ok")
    path = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat_ws("/", "event_type", F.col("event_id").cast("string")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), kind.alias("status"), path.alias("local_path"), F.col("ts").alias("at"))
    log = ManifestLog(spark, new_path(spark, "manifest"))
    parts = [rows.where("at < DATE'2024-01-11'"), rows.where("at >= DATE'2024-01-11' AND at < DATE'2024-01-21'"), rows.where("at >= DATE'2024-01-21'")]
    log.append(parts[0], 0)
    log.append(parts[1], 1)
    log.compact()
    log.append(parts[1], 1)
    log.append(parts[2], 2)
    return log.last_good().drop("at")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')")
def first_wins_exact_dedup(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return dedup.first_id_by(docs, F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0B]+", ""), "doc_id").select("doc_id")


@query("""
WITH v AS (SELECT vec_id, embedding::double[] AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id
WHERE round(list_cosine_similarity(a.v, b.v), 6) > 0.4""")
def neardup_pairs(spark, sf_dir):
    """All links above a threshold that suits the synthetic vectors, which hold no copies."""
    return dense.similar_pairs(vectors(spark, sf_dir, "id"), 0.4)


@query("""
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, embedding::double[] AS v FROM embeddings),
near AS (SELECT b.i, list(a.vec_id) AS ids FROM v a JOIN v b ON a.i < b.i WHERE round(list_cosine_similarity(a.v, b.v), 6) > 0.4 GROUP BY b.i),
step AS (SELECT 0::bigint AS i, []::bigint[] AS kept
  UNION ALL SELECT v.i, CASE WHEN len(list_intersect(s.kept, coalesce(near.ids, []))) = 0 THEN list_append(s.kept, v.vec_id) ELSE s.kept END FROM step s JOIN v ON v.i = s.i + 1 LEFT JOIN near ON near.i = v.i)
SELECT unnest(kept) AS id FROM step WHERE i = (SELECT count(*) FROM v)""")
def neardup_greedy(spark, sf_dir):
    """Vectors kept when each goes that is near an earlier kept one."""
    rows = vectors(spark, sf_dir, "id")
    return dedup.greedy_kept(dense.similar_pairs(rows, 0.4), rows.select("id"))


@query("""
SELECT 'lang' AS dimension, lang AS value, count(*) AS docs, sum(length(text))::bigint AS chars FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*), sum(length(text))::bigint FROM documents GROUP BY source
UNION ALL SELECT 'all', NULL, count(*), sum(length(text))::bigint FROM documents""")
def corpus_stats(spark, sf_dir):
    return profile.corpus_stats(table(spark, sf_dir, "documents"))


@query(f"""
WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql(0.3)}, {PER_PARENT_SQL},
blocks AS (SELECT query_id, p.ord, '[' || p.ord || '] · ' || parent_id || chr(10) || text AS block FROM per_parent p JOIN documents d ON d.doc_id = p.child_id)
SELECT query_id, count(*) AS n_blocks, max(used)::bigint AS used, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS context
FROM (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY ord) AS used FROM blocks) WHERE used <= 12000 GROUP BY query_id""")
def context_budget(spark, sf_dir):
    hits = children(spark, sf_dir).select("child_id", "text").join(F.broadcast(_per_parent(spark, sf_dir)), "child_id")  # few for each benchmark passage: texts stay where they lie
    return context.contexts(context.blocks(hits, title="parent_id"))


@query("""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS text FROM documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normal_blanks(F.col("text")).alias("text"))


def _untitled(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("doc_title"), "text")


@query()
def chunk_length_mode(spark, sf_dir):
    return chunking.children(chunking.parents(_untitled(spark, sf_dir)))


@query()
def chunk_semantic_mode(spark, sf_dir):
    """Packs close where a sentence is far from the one before, by the built-in embedder."""
    return chunking.children(embedding.with_distances(chunking.parents(_untitled(spark, sf_dir))), F.col("distances"))


@query("SELECT doc_id, 'd_' || sha256(source || chr(31) || doc_id)[:16] AS id FROM documents")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.stable_id("d_", F.col("source"), F.col("doc_id")).alias("id"))


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
  len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, len(regexp_extract_all(html, '<a[^>]*href="[^"#][^"]*"')) AS n_links FROM pages""")
def html_extract(spark, sf_dir):
    page = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(page).alias("title"), F.regexp_count(page, F.lit("<p[ >]")).alias("n_paragraphs"), F.regexp_count(page, F.lit('<a[^>]*href="[^"#][^"]*"')).alias("n_links"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.host_of(F.col("url")).alias("host"))


# --- conversations and question sets -----------------------------------------------------------------------------
@query("""
SELECT conv_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' AND length(text) > 200 THEN text[:200] || '…' ELSE text END, chr(10) ORDER BY turn) AS history FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 8 GROUP BY conv_id""")
def history_format(spark, sf_dir):
    last = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(last)).where("back <= 8")  # a partial cut comes before the shuffle
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
    return listed.select("conv_id", tx.history_lines(F.col("history")).alias("history"))


QA_SQL = """
qa AS (SELECT conv_id, turn, text AS question, answer FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def _qa(spark, sf_dir):
    turns = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(turns)).withColumn("answer", F.lead("text").over(turns))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query(f"WITH {QA_SQL} SELECT * FROM qa")
def qa_pairs(spark, sf_dir):
    return _qa(spark, sf_dir)


@query("""
WITH one AS (SELECT p_type, p_brand, min(p_partkey) AS k FROM part GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY k) AS n FROM one)
SELECT a.p_type AS field, a.p_brand AS first, b.p_brand AS second FROM n a JOIN n b ON a.p_type = b.p_type AND a.n = 1 AND b.n = 2""")
def cross_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("field"), F.col("p_brand").alias("subject"), "p_partkey")
    return mining.first_two(rows, "field", "subject", ["p_partkey"]).select("field", F.col("a.subject").alias("first"), F.col("b.subject").alias("second"))


GOLD_SQL = "gold AS (SELECT item_id AS query_id, min(doc_id) AS gold FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)"


def _gold(spark, sf_dir):
    found = theta_contains(spark, sf_dir).groupBy("query_id").agg(F.min("child_id").alias("gold"))
    return questions(spark, sf_dir).select("query_id").join(found, "query_id", "left")


@query(f"""
WITH {BM25_SQL}, {GOLD_SQL},
cand AS (SELECT bm.query_id, bm.child_id, d.text, bm.ord, g.text AS gold_text FROM bm JOIN gold USING (query_id) JOIN documents g ON g.doc_id = gold.gold JOIN documents d ON d.doc_id = bm.child_id
  WHERE bm.ord <= 30 AND bm.child_id <> gold.gold AND length(d.text) >= 20),
sq AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS a, regexp_replace(gold_text, '\\s+', '', 'g') AS b FROM cand),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM sq WHERE NOT (a = b OR (least(length(a), length(b)) >= 30 AND CASE WHEN length(a) <= length(b) THEN contains(b, a) ELSE contains(a, b) END)))
SELECT query_id, count(*) AS n_neg, list(text[:1500] ORDER BY n) AS neg FROM ok WHERE n <= 5 GROUP BY query_id""")
def hard_negatives(spark, sf_dir):
    kids = children(spark, sf_dir)
    # thirty hits and one right document at most for each benchmark passage are sent to the texts, which stay where they lie
    hits = kids.select("child_id", "text").join(F.broadcast(_bm25(spark, sf_dir, 30)), "child_id").select("query_id", F.col("child_id").alias("parent_id"), "text", "ord")
    gold = kids.select(F.col("child_id").alias("gold"), F.col("text").alias("gold_text")).join(F.broadcast(_gold(spark, sf_dir).where("gold IS NOT NULL")), "gold").select("query_id", F.col("gold").alias("gold_id"), "gold_text")
    prose = F.lit("prose")
    same = mining.same_fact(prose, F.lit(""), F.lit(""), F.col("text"), prose, F.lit(""), F.lit(""), F.col("gold_text"))
    return mining.hard_negatives(hits, gold, same, 5)


def _key_sql(seed: str) -> str:
    return f"('0x' || sha256(conv_id || '-' || turn || chr(31) || '{seed}')[:8])::ubigint / 4294967296.0"


@query(f"""
WITH {QA_SQL}, rolled AS (SELECT *, {_key_sql("mix")} AS r, {_key_sql("place")} AS p FROM qa)
SELECT conv_id, turn, CASE WHEN r < 0.15 THEN 'refusal_random' WHEN r < 0.5 THEN 'distract' ELSE 'answer' END AS sample_type,
  (floor(p * 4) + 1)::integer AS citation, answer || '[' || (floor(p * 4) + 1)::integer || ']' AS target FROM rolled""")
def sft_mix(spark, sf_dir):
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    others = F.array(*[F.lit(x) for x in ("a", "b", "c")])
    rows = _qa(spark, sf_dir).withColumn("placed", mining.with_gold_inserted(others, F.col("answer"), key, "place"))
    kind = mining.sample_type(key, F.lit(False), "mix")
    return rows.select("conv_id", "turn", kind.alias("sample_type"), F.col("placed.at").alias("citation"), F.concat(F.element_at("placed.records", F.col("placed.at")), F.lit("["), F.col("placed.at").cast("string"), F.lit("]")).alias("target"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id || chr(31) || 'sample')) AS place FROM documents ORDER BY place LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A hundred documents in a seeded order: the limit is the sample."""
    rows = table(spark, sf_dir, "documents").select("doc_id", mining.seeded_order(F.col("doc_id"), "sample").alias("o")).orderBy("o").limit(100)
    return rows.select("doc_id", F.row_number().over(W.orderBy("o")).cast("long").alias("place"))


@query(f"""
WITH {QA_SQL} SELECT conv_id, turn, CASE WHEN length(answer) < 5 THEN 'too_short'
  WHEN contains(translate(regexp_replace(question, '\\s+', '', 'g'), '（）［］｛｝：；，。％－＋　', '()[]{{}}:;,.%-+ '), translate(regexp_replace(answer, '\\s+', '', 'g'), '（）［］｛｝：；，。％－＋　', '()[]{{}}:;,.%-+ ')) THEN 'accepted' ELSE 'not_in_clause' END AS outcome FROM qa""")
def grounding(spark, sf_dir):
    return mining.grounded(_qa(spark, sf_dir), "answer", "question").select("conv_id", "turn", "outcome")


# --- evaluation --------------------------------------------------------------------------------------------------
def _metrics_sql(ranks: str, by: str = "") -> str:
    parts = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg_{k}" for k in evaluation.KS)
    return f"SELECT {by + ', ' if by else ''}count(*) AS n, {parts}, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM ({ranks})" + (f" GROUP BY {by}" if by else "")


@query(f"WITH {BM25_SQL}, {GOLD_SQL} " + _metrics_sql("SELECT gold.query_id, ord AS rank FROM gold LEFT JOIN bm ON bm.query_id = gold.query_id AND bm.child_id = gold.gold"))
def ir_metrics(spark, sf_dir):
    return evaluation.metrics(evaluation.gold_ranks(_gold(spark, sf_dir), _bm25(spark, sf_dir)))


_STAGE_RANKS = " UNION ALL ".join(f"SELECT '{stage}' AS stage, gold.query_id, ord AS rank FROM gold LEFT JOIN {name} x ON x.query_id = gold.query_id AND x.child_id = gold.gold" for stage, name in (("bm25", "bm"), ("dense", "den"), ("plain", "plain"), ("score", "fused")))


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {GOLD_SQL}, {fused_sql(0.0, name='plain')}, {fused_sql(0.3)} " + _metrics_sql(_STAGE_RANKS, "stage"))
def ablation(spark, sf_dir):
    channels, gold = _channels(spark, sf_dir), _gold(spark, sf_dir)
    stages = channels | {"plain": fusion.fuse(channels, alpha=0.0), "score": fusion.fuse(channels)}
    asked, found = None, None
    for stage, hits in stages.items():
        hits = hits.select(F.lit(stage).alias("stage"), "query_id", "child_id", "ord")
        goals = gold.select(F.lit(stage).alias("stage"), "query_id", "gold")
        found = hits if found is None else found.union(hits)
        asked = goals if asked is None else asked.union(goals)
    ranks = asked.join(found.withColumnRenamed("child_id", "gold"), ["stage", "query_id", "gold"], "left").select("stage", "query_id", F.col("ord").alias("rank"))
    return evaluation.metrics(ranks, ("stage",))


def _thinned_questions(spark, sf_dir):
    """Every third word of each question, so that no document holds it word for word."""
    kept = F.filter(tx.words(F.col("text")), lambda w, i: i % 3 == 0)
    return questions(spark, sf_dir).select("query_id", F.array_join(kept, " ").alias("text"))


def _second_stage_pool(spark, sf_dir):
    """The merged candidates of the thinned questions, with both texts; written once, as training and ranking read it."""
    kids, asked = children(spark, sf_dir), _thinned_questions(spark, sf_dir)
    channels = {"bm25": bm25.search(bm25.build(kids), asked, 50), "dense": _dense(spark, sf_dir)}
    merged = fusion.fuse(channels).select("query_id", "child_id", "score", "ord")  # few for each benchmark passage: texts stay where they lie
    pool = kids.select("child_id", "text").join(F.broadcast(merged), "child_id")
    path = new_path(spark, "rerank-pool")
    pool.join(asked.select("query_id", F.col("text").alias("query")), "query_id").write.parquet(path)
    return spark.read.parquet(path)


@query()
def ablation_learnt(spark, sf_dir):
    """The second stages on the half of the thinned questions that the learnt one has not seen."""
    held_out = F.crc32(F.col("query_id").cast("string")) % 2 == 0
    pool, path = _second_stage_pool(spark, sf_dir), new_path(spark, "rerank-gold")
    _gold(spark, sf_dir).write.parquet(path)  # training and each stage's ranks read it; texts are searched once
    gold = spark.read.parquet(path)
    weights, _ = learnt.train(pool.where(~held_out), gold.where(~held_out))
    goals = gold.where(held_out & F.col("gold").isNotNull())
    ranks = []
    for stage, scorer in (("merged", None), ("overlap", rerank.overlap), ("learnt", learnt.scorer(weights))):
        rows = pool.where(held_out)
        hits = rows if scorer is None else rerank.rerank(rows, scorer, fusion.KEEP)
        ranks.append(evaluation.gold_ranks(goals, hits).withColumn("stage", F.lit(stage)))
    return evaluation.metrics(reduce(DataFrame.unionByName, ranks), ("stage",))


@query(f"""
WITH {QA_SQL}, x AS (SELECT conv_id, turn, replace(replace(answer, ',', ''), '，', '') AS a, answer,
  list_distinct(regexp_extract_all(question, '\\d+(?:[,，]\\d{{3}})*(?:\\.\\d+)?%?|\\d{{1,2}}:\\d{{2}}')) AS nums,
  list_distinct(list_filter(regexp_extract_all(question, '\\d+(?:\\.\\d+)?%?|[一-鿿]{{2,}}|[A-Za-z]{{3,}}'), lambda w: length(w) >= 2)) AS words FROM qa)
SELECT conv_id, turn, round(CASE WHEN len(nums) > 0 THEN len(list_filter(nums, lambda n: contains(a, replace(replace(n, ',', ''), '，', '')))) / len(nums) END, 6) AS fidelity,
  round(CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(answer, w))) / len(words) ELSE 0.0 END, 6) AS coverage FROM x""")
def fidelity(spark, sf_dir):
    """The question stands in for a right answer."""
    return _qa(spark, sf_dir).select("conv_id", "turn", F.round(evaluation.numeric_fidelity(F.col("answer"), F.col("question")), 6).alias("fidelity"), F.round(evaluation.keyword_coverage(F.col("answer"), F.col("question")), 6).alias("coverage"))


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[least(floor(count(*) * 0.95)::integer, count(*)::integer - 1) + 1] AS p95 FROM events GROUP BY event_type""")
def timing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    means = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    late = evaluation.value_at(rows, "value", ("event_type",)).select("event_type", F.col("value").alias("p95"))
    return means.join(late, "event_type", "left")


@query("""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*)::double AS n FROM c GROUP BY ALL),
b AS (SELECT item_id, w, count(*)::double AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark) GROUP BY ALL)
SELECT item_id, doc_id, sum(b.n * tf.n) AS dot FROM b JOIN tf USING (w) JOIN (SELECT item_id, min(doc_id) AS doc_id FROM benchmark x JOIN documents d ON contains(d.text, x.text) GROUP BY ALL) USING (item_id, doc_id) GROUP BY ALL""")
def sparse_products(spark, sf_dir):
    """Term-count maps of each question and of the first document that holds it."""

    def weights(df, key, name):
        counted = df.select(key, F.explode(tx.words(F.col("text"))).alias("w")).groupBy(key, "w").agg(F.count("*").cast("double").alias("n"))
        return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias(name))

    pairs = _gold(spark, sf_dir).where("gold IS NOT NULL").select(F.col("query_id").alias("item_id"), F.col("gold").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = pairs.join(weights(table(spark, sf_dir, "benchmark"), "item_id", "a"), "item_id").join(weights(docs, "doc_id", "b"), "doc_id")
    return rows.select("item_id", "doc_id", sparse_dot(F.col("a"), F.col("b")).alias("dot"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_windows(spark, sf_dir):
    out = streams.windowed_counts(table(spark, sf_dir, "events"))
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))


@query("""
WITH RECURSIVE r AS (SELECT user_id AS session_id, ts, event_type = 'error' AS clears, event_type || ' ' || event_id AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
step AS (SELECT session_id, i, CASE WHEN NOT clears THEN ts END AS began FROM r WHERE i = 1
  UNION ALL SELECT r.session_id, r.i, CASE WHEN r.clears THEN NULL WHEN s.began IS NULL OR r.ts - s.began > INTERVAL 2 DAY THEN r.ts ELSE s.began END FROM step s JOIN r ON r.session_id = s.session_id AND r.i = s.i + 1),
back AS (SELECT session_id, began, i, text, row_number() OVER (PARTITION BY session_id, began ORDER BY i DESC) AS back FROM step JOIN r USING (session_id, i) WHERE began IS NOT NULL)
SELECT session_id, began, count(*) AS n, string_agg(text, chr(10) ORDER BY i) FILTER (back <= 4) AS history FROM back GROUP BY session_id, began""")
def session_memory(spark, sf_dir):
    """Users as chat sessions that an error clears, with memories of four texts and two days."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), (F.col("event_type") == "error").alias("clears"))
    return memory.session_memory(rows, 4, 2 * 86400).withColumn("began", F.col("began").cast("timestamp_ntz"))


@query("SELECT r_name AS region, count(DISTINCT o_custkey) AS customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def revenue_by_region(spark, sf_dir):
    """A plain star join, to show that the engine's tables are ordinary ones."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.countDistinct("o_custkey").alias("customers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
