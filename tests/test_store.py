"""The keyed store touches only the buckets of its changes, and trees of comparisons reach the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import where
from sievegrid.plans import catalog
from sievegrid.sources.store import Store

ROWS = "id long, vec array<double>, note string"


def files(tmp_path):
    return {str(p.relative_to(tmp_path)) for p in (tmp_path / "s" / "rows").glob("_bucket=*/*.parquet")}


def held(store):
    return sorted(tuple(r) for r in store.rows().select("id", "note").collect())


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i)], "old") for i in range(200)] + [(None, [0.0], "no key")], ROWS)
    store = Store.create(rows, str(tmp_path / "s"), "id", 16)
    before = files(tmp_path)
    assert len({f.split("/")[2] for f in before}) == 16 and store.count() == 200
    change = spark.createDataFrame([(7, [1.0], "new"), (7, [2.0], "newest"), (500, [3.0], "new"), (None, [0.0], "no key")], ROWS)
    store.upsert(change)
    touched = {f"_bucket={r.b}" for r in change.where("id IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).collect()}
    changed = {f.split("/")[2] for f in before ^ files(tmp_path)}
    assert changed == touched and len(touched) <= 2
    want = {i: "old" for i in range(200)} | {7: "newest", 500: "new"}
    again = Store.open(spark, str(tmp_path / "s"))
    assert held(again) == sorted(want.items()) and again.rows().columns == ["id", "vec", "note"]


def test_store_removes_and_resets(spark, tmp_path):
    store = Store.create(spark.createDataFrame([(i, [1.0], "x") for i in range(9)], ROWS), str(tmp_path / "s"), "id", 64)
    store.remove(spark.createDataFrame([(3,), (4,), (77,), (None,)], "id long"))  # buckets of one row go as folders
    assert [i for i, _ in held(store)] == [0, 1, 2, 5, 6, 7, 8]
    assert len(files(tmp_path)) <= 7
    store.remove(spark.createDataFrame([], "id long"))
    assert store.count() == 7
    store.reset()
    assert store.count() == 0 and store.lookup(spark.createDataFrame([(1,)], "id long")).count() == 0
    store.upsert(spark.createDataFrame([(1, None, None)], ROWS))
    assert held(store) == [(1, None)]


def test_lookup_reads_only_its_buckets(spark, tmp_path):
    store = Store.create(spark.createDataFrame([(i, [1.0], str(i)) for i in range(100)], ROWS), str(tmp_path / "s"), "id", 32)
    found = store.lookup(spark.createDataFrame([(5,), (5,), (1000,)], "id long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(5).cast("long")), F.lit(32)).alias("b")).first().b
    assert "PartitionFilters" in plan and f"{bucket}" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [(r.id, r.note) for r in found.collect()] == [(5, "5")]
    assert store.lookup(spark.createDataFrame([], "id long")).count() == 0


def test_trees_reach_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, wanted in {"eq": "EqualTo(lang,en)", "ne": "Or(Not(EqualTo(lang,en)),IsNull(lang))", "in": "In(lang, [de,fr])", "range": "GreaterThanOrEqual(n_chars,500)", "and": "GreaterThan(n_chars,700)"}.items():
        plan = docs.where(where.condition(catalog.TREES[name])).select("doc_id")._jdf.queryExecution().executedPlan().toString()
        assert wanted in plan.split("PushedFilters: ")[1], name
        assert "ReadSchema: struct<doc_id:bigint" in plan and "text" not in plan.split("ReadSchema")[1]


def test_trees_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "b", None)], "id int, s string, n int")
    take = lambda tree: [r.id for r in rows.where(where.condition(tree)).orderBy("id").collect()]
    assert take(None) == take({}) == take({"$and": []}) == take({"s": {"$nin": []}}) == [1, 2, 3]
    assert take({"s": "a"}) == [1] and take({"s": {"$ne": "a"}}) == [2, 3] and take({"s": {"$nin": ["a"]}}) == [2, 3]
    assert take({"$or": []}) == take({"s": {"$in": []}}) == []
    assert take({"s": "a", "n": {"$gt": 0, "$lt": 2}}) == [1] and take({"$or": [{"n": 2}, {"s": "b"}]}) == [2, 3]
    for bad in ({"$not": []}, {"s": {"$like": "a"}}):
        with pytest.raises(ValueError):
            where.condition(bad)
