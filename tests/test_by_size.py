"""Keys of bounded size take one exchange, hot keys go through cells; both give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from cinderframe.checks import tables, telemetry
from cinderframe.operators import spans as sp, values as vl
from cinderframe.plans import scan


def _cut(monkeypatch, module, limit):
    monkeypatch.setattr(module, "split_by_size", lambda df, keys, also=(): scan.split_by_size(df, keys, also, limit))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_split_by_size_tells_hot_keys_apart(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0), (None, 0)], "k string, n int")
    assert scan.split_by_size(rows, ["k"], limit=5) is None
    cold, hot = scan.split_by_size(rows, ["k"], limit=4)
    assert sorted(r["k"] or "" for r in rows.where(cold).collect()) == ["", "b"]
    assert rows.where(hot).count() == 5
    cold, hot = scan.split_by_size(rows, ["k"], (rows,), 1)
    assert rows.where(cold).count() == 0 and rows.where(hot).count() == 7


@pytest.mark.parametrize("limit", [2, 1000])
def test_pairing_of_cold_and_hot_queues(spark, monkeypatch, limit):
    _cut(monkeypatch, vl, limit)
    calls = [("S", 1, 10 * i, f"c{i}") for i in range(4)] + [("S", None, 5, "n"), ("B", 2, 7, "b")]
    records = [("S", 1, 3 * i, str(i)) for i in range(3)] + [("S", None, 1, None), ("R", 2, 1, "r")]
    got = vl.pair_in_order(
        spark.createDataFrame(calls, "tag string, key long, seq long, name string"),
        spark.createDataFrame(records, "tag string, key long, seq long, value string"), ["tag", "key"], "seq", "value",
    )
    assert got.columns == ["tag", "key", "seq", "name", "nth", "value", "status"]
    assert dict(got.dtypes)["nth"] == "bigint"
    assert sorted((r["name"], r["nth"], r["value"], r["status"]) for r in got.collect()) == [
        ("b", 1, None, "exhausted"), ("c0", 1, "0", "ok"), ("c1", 2, "1", "ok"), ("c2", 3, "2", "ok"), ("c3", 4, None, "exhausted"), ("n", 1, None, "ok"),
    ]


def test_calls_and_records_without_order_meet_as_they_came(spark):
    rows = spark.createDataFrame([(1, None, i, 9 - i) for i in range(5)], "key long, seq long, a long, b long").coalesce(1)
    got = vl.pair_in_order(rows.select("key", "seq", "a"), rows.select("key", "seq", "b"), ["key"], "seq", "b")
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(i, 9 - i) for i in range(5)]


def test_cold_queues_and_words_take_one_exchange(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 3, "b")], "key long, seq long, value string")
    assert _exchanges(vl.pair_in_order(rows.select("key", "seq"), rows, ["key"], "seq", "value")) == 1
    assert _exchanges(vl.ordered_distinct(rows, ["key"], "value", "seq")) == 1


@pytest.mark.parametrize("limit", [2, 1000])
def test_ordered_distinct_of_cold_and_hot_keys(spark, monkeypatch, limit):
    _cut(monkeypatch, vl, limit)
    rows = [(1, w, i) for i, w in enumerate("abacb")] + [(2, "z", 9), (None, None, 0), (None, "a", 1)]
    got = vl.ordered_distinct(spark.createDataFrame(rows, "doc long, word string, at int"), ["doc"], "word", "at")
    assert got.columns == ["doc", "word", "first_position", "rank"] and dict(got.dtypes)["rank"] == "bigint"
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(str, [(1, "a", 0, 1), (1, "b", 1, 2), (1, "c", 3, 3), (2, "z", 9, 1), (None, None, 0, 1), (None, "a", 1, 2)])
    )


def _greedy(edits):
    kept = []
    for file, start, end, priority in sorted(set(edits), key=lambda e: (-e[3], e[1] - e[2], e[1])):
        if not any(f == file and start < e and s < end for f, s, e, _ in kept):
            kept.append((file, start, end, priority))
    return sorted(kept)


@pytest.mark.parametrize("fold_limit", [2, 1000])
@pytest.mark.parametrize("limit", [20, 1000])
def test_edits_of_cold_and_hot_files(spark, monkeypatch, limit, fold_limit):
    _cut(monkeypatch, sp, limit)
    draw = random.Random(3)
    edits = [(f, s, s + draw.randrange(0, 12), draw.randrange(3)) for f in ("a", "b") for s in (draw.randrange(60) for _ in range(40 if f == "a" else 12))]
    edits += edits[:5]
    df = spark.createDataFrame(edits, "file string, start long, end long, priority int")
    assert sorted(map(tuple, sp.select_edits(df, ["file"], fold_limit).select(*df.columns).collect())) == _greedy(edits)


def test_edits_of_cold_files_are_settled_in_one_exchange(spark):
    df = spark.createDataFrame([("a", 0, 5, 1), ("a", 3, 6, 2)], "file string, start long, end long, _rank int")
    assert _exchanges(sp._clusters_by_key(df, ["file"])) == 1


def test_spread_bounds_the_rows_of_a_task(spark):
    df = spark.range(0, 1000, 1, 2)
    tasks = spark.sparkContext.defaultParallelism
    assert tables.spread(df, "id", rows=10).rdd.getNumPartitions() == max(100, tasks)
    assert tables.spread(df, "id", rows=10**6).rdd.getNumPartitions() == max(2, tasks)


def test_depth_records_are_computed_once(spark, tmp_path, monkeypatch):
    orders = [(1, 3, "O", 0), (2, 3, "F", 0), (3, 4, "O", 0), (4, 4, "F", 0)]
    items = [(k, n) for k in (1, 2, 3) for n in range(3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o int").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    names = []
    real = telemetry.written
    monkeypatch.setattr(telemetry, "written", lambda df, name: names.append(name) or real(df, name))
    got = telemetry.stability_upsert(spark, str(tmp_path))
    assert names == ["depth-records"]
    assert sorted((r["ref"], r["mode"], r["stable"], r["wall_ns"]) for r in got.collect()) == [(3, 0, True, 3), (3, 1, True, 2), (4, 0, False, 4)]
