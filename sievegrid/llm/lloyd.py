"""Centroid clustering by Lloyd's rounds that move differences only.

Vectors are written once, bucketed by a row number. Each round reads them beside the assignments of the round before,
which lie in the same buckets, so the join moves nothing. A vector whose centroid stayed where it was keeps its distance
and is compared with the centroids that moved; only vectors whose own centroid moved are compared with all. Vectors that
change hands are subtracted from one cluster's sum and added to the other's: a task returns one row of signed whole
numbers for each cluster it touched, and the driver holds the sums of the clusters, so many numbers as centroids have.
Assignments are written each round; when no centroid moves, the rounds that are left would change nothing and fall away.

Components are turned to whole numbers, so that all sums, means (rounded down) and distances are exact whatever the
order of rows.

Defined results: vectors with another number of components, or with a null or non-finite one, take no part, and
neither do those with a component of 131,072 or more, whose squared distances a long can't hold; the seeds are
the kept vectors of smallest hash, ties by vector, null ids last; with fewer vectors than clusters each vector is a seed;
ties go to the smaller cluster; rows that share an id, or have none, are vectors of their own; sums of distances beyond a long
are null; an empty table gives an empty result; other columns are ignored, whatever their names. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.shared import BucketedTable, Table, read_table
from sievegrid.llm.topk import scores

CLUSTERS, ROUNDS, DIM = 8, 10, 64
SCALE = 1024
SEED = 3
#: Components from here on are too large: 64 squares of twice as much still fit a long.
TOO_LARGE = 1 << 17
#: Rows of a bucket, about; small tables are cut into as many buckets as there are cores, of no fewer rows than the second.
BUCKET_ROWS, LEAST_ROWS = 1 << 18, 1 << 12
_STATE = "row_no long, cluster int, distance long, delta array<long>, held long"


def squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows and centres."""
    return (rows * rows).sum(axis=1)[:, None] - 2 * scores(rows, centres) + (centres * centres).sum(axis=1)


def reassigned(rows: np.ndarray, owner: np.ndarray, distance: np.ndarray, centres: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance, from those of the round before; an owner of -1 is none."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | np.isin(owner, moved)
    if lost.any():
        far = squares(rows[lost], centres)
        owner[lost] = far.argmin(axis=1)
        distance[lost] = far.min(axis=1)
    if len(moved) and not lost.all():
        still = np.flatnonzero(~lost)
        far = squares(rows[still], centres[moved])
        best, at = far.min(axis=1), moved[far.argmin(axis=1)]
        won = (best < distance[still]) | ((best == distance[still]) & (at < owner[still]))
        owner[still[won]], distance[still[won]] = at[won], best[won]
    return owner, distance


def _round(centres: np.ndarray, moved: np.ndarray):
    k, dim = centres.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta, held = [[0] * dim for _ in range(k)], [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.asarray(batch.column("vec").flatten(), dtype=np.int64).reshape(-1, dim)
            before = batch.column("cluster").to_numpy().astype(np.int64)
            owner, distance = reassigned(rows, before, batch.column("distance").to_numpy(), centres, moved)
            other = owner != before
            for cluster in range(k):
                gained, lost = other & (owner == cluster), other & (before == cluster)
                held[cluster] += int(gained.sum()) - int(lost.sum())
                change = rows[gained].sum(axis=0) - rows[lost].sum(axis=0)
                delta[cluster] = [a + b for a, b in zip(delta[cluster], change.tolist())]
            nothing = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array(owner, pa.int32()), pa.array(distance), nothing.cast(pa.list_(pa.int64())), nothing.cast(pa.int64())], names=["row_no", "cluster", "distance", "delta", "held"])
        told = [c for c in range(k) if held[c] or any(delta[c])]
        if told:
            columns = [[None] * len(told), told, [None] * len(told), [delta[c] for c in told], [held[c] for c in told]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["row_no", "cluster", "distance", "delta", "held"])

    return each


def _add_transfers(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Adds what changed hands to the sums; as many rows reach the driver as the centroids have components."""
    told = state.where("row_no IS NULL").select("cluster", "held", F.posexplode("delta").alias("axis", "value"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)  # noqa: E731  partial sums of many tasks may outgrow a long
    for r in told.groupBy("cluster", "axis").agg(exact("value"), exact("held")).collect():
        sums[r.cluster][r.axis] += int(r.value)
        if r.axis == 0:
            counts[r.cluster] += int(r.held)


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each vector that takes part."""
    spark = rows.sparkSession
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    kept = rows.select(F.col(id_col).alias("vec_id"), vec.alias("x")).where((F.size("x") == dim) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE)))
    kept = kept.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("vec"), F.monotonically_increasing_id().alias("row_no"))
    numbered = Table(kept, "lloyd-rows")  # written before it is dealt, so that a lost task can't number rows anew
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centres = np.array([r.vec for r in numbered.df.orderBy(drawn.asc_nulls_last(), "vec").limit(k).select("vec").collect()], dtype=np.int64).reshape(-1, dim)
    total = numbered.df.count()
    buckets = max(1, -(-total // BUCKET_ROWS), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)))
    vectors = BucketedTable(numbered.df.repartition(buckets, "row_no"), "lloyd-vectors", "row_no", buckets)
    numbered.drop()

    state: BucketedTable | None = None
    sums, counts, moved = [[0] * dim for _ in centres], [0] * len(centres), np.arange(len(centres))
    for turn in range(rounds + 1):
        if state is None:
            now = vectors.df.select("row_no", "vec", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        else:
            own = state.df.select("row_no", "cluster", "distance").where("row_no IS NOT NULL")
            now = vectors.df.select("row_no", "vec").join(own.hint("shuffle_hash"), "row_no")
        after = BucketedTable(now.mapInArrow(_round(centres, moved), _STATE), "lloyd-state", "row_no", buckets)
        if state is not None:
            state.drop()
        state = after
        if turn == rounds:
            break
        _add_transfers(state.df, sums, counts)
        replaced = np.array([[s // n for s in own] if n else old.tolist() for own, n, old in zip(sums, counts, centres)], dtype=np.int64).reshape(-1, dim)
        moved, centres = np.flatnonzero((replaced != centres).any(axis=1)), replaced
        if not len(moved):
            break

    own = state.df.where("row_no IS NOT NULL").select("row_no", "cluster", "distance")
    inertia = {r.cluster: int(r.total) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    told = [(c, fits(inertia.get(c, 0)), fits(sum(inertia.values())), sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres.tolist())]
    summary = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # ``k`` rows
    out = vectors.df.select("row_no", "vec_id").join(own.hint("shuffle_hash"), "row_no").join(summary, "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_deltalloyd(spark, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    ctes = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {TOO_LARGE})) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS num, v AS c FROM (
    SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CLUSTERS}))"""]
    for r in range(ROUNDS + 1):
        ctes.append(f"""
a{r} AS MATERIALIZED (
  SELECT row_no, vec_id, v, num, d FROM (
    SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY d, num) AS n FROM (
      SELECT row_no, vec_id, v, num, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint AS d FROM kept CROSS JOIN c{r})) WHERE n = 1)""")
        if r < ROUNDS:
            ctes.append(f"""
m{r} AS MATERIALIZED (
  SELECT num, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY axis) AS c FROM (
    SELECT num, axis, sum(x) AS s, count(*) AS n FROM (SELECT num, unnest(v) AS x, generate_subscripts(v, 1) AS axis FROM a{r}) GROUP BY ALL) GROUP BY num),
c{r + 1} AS MATERIALIZED (SELECT num, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (num))""")
    return f"""WITH {','.join(ctes)}
SELECT vec_id, num::integer AS cluster, d AS distance, (sum(d) OVER (PARTITION BY num))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (num)"""


SQL = _sql()
