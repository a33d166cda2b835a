"""Replay of calls with queues that run out, nested spans and components, against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderframe.operators import spans as sp
from cinderframe.operators import values as vl
from cinderframe.plans.components import components

CALLS = "file string, site long, start long, end long, typed boolean, keys array<long>, size int"
QUEUES = "file string, key long, records long"


def plain(calls, queues):
    """One call after another, as a person would: queues are used up, accepted calls hide what lies inside them."""
    out = {}
    for file in {c[0] for c in calls}:
        left = {k: n for f, k, n in queues if f == file and n > 0}
        ranges = []
        for _, site, start, end, typed, keys, size in sorted((c for c in calls if c[0] == file), key=lambda c: (c[2], -c[3], c[1])):
            if any(start < e and s < end for s, e in ranges):
                out[file, site] = (None, "nested")
                continue
            key = next((k for k in keys or [] if k in left), None)
            if key is None:
                out[file, site] = (None, "missing-trace-record")
                continue
            if not typed:
                out[file, site] = (key, "unsupported-result-type")
                continue
            records, fits = left.pop(key), (site + key) % 4 > 0
            if not fits:
                outcome = "unsupported-record-format" if records == 1 else "unsupported-repeated-trace-id"
            elif records > 1:
                outcome = "repeated"
            else:
                outcome = "large" if (size or 0) > 64 else "replaced"
            out[file, site] = (key, outcome)
            if fits:
                ranges.append((start, end))
    return out


def replayed(spark, calls, queues, limit):
    options = vl.call_options(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(queues, QUEUES), ["file"], (F.col("site") + F.col("key")) % 4 > 0, F.col("size")
    )
    rows = vl.replay_calls(options, ["file"], limit).collect()
    found = {(r.file, r.site): ((r.matched_key, r.outcome)) for r in rows}
    assert len(found) == len(rows)
    nested = {k for k, v in found.items() if v[1] == "nested"}
    return {k: ((None, "nested") if k in nested else v) for k, v in found.items()}


def random_case(seed, n, keys, width):
    rng = random.Random(seed)
    calls = []
    for site in range(n):
        file = rng.choice(["a", "b", None])
        start = rng.randrange(width)
        wanted = [rng.randrange(keys) for _ in range(rng.randint(0, 3))]
        calls.append((file, site, start, start + rng.randint(1, 12), rng.random() < 0.8, wanted, rng.choice([None, 10, 100])))
    queues = [(f, k, rng.randint(0, 3)) for f in ("a", "b", None) for k in range(keys)]
    return calls, queues


@pytest.mark.parametrize("seed, n, keys, width", [(1, 200, 25, 300), (2, 200, 3, 2000), (3, 200, 200, 60)])
def test_replay_by_folds(spark, seed, n, keys, width):
    calls, queues = random_case(seed, n, keys, width)
    assert replayed(spark, calls, queues, 1000) == plain(calls, queues)


def test_replay_by_rounds(spark):
    """Small parts are folded, larger ones go through rounds until they fall apart."""
    calls, queues = random_case(4, 70, 60, 400)
    assert replayed(spark, calls, queues, 6) == plain(calls, queues)


def test_outer_call_hides_the_inner_one_only_when_it_gets_a_value(spark):
    outer, inner = ("f", 1, 0, 50, True, [28], None), ("f", 2, 10, 30, True, [29], None)
    both = [("f", 28, 2), ("f", 29, 2)]
    for limit in (1000, 1):
        assert replayed(spark, [outer, inner], both, limit) == {("f", 1): (28, "repeated"), ("f", 2): (None, "nested")}
    assert replayed(spark, [outer, inner], both[1:], 1000) == {("f", 1): (None, "missing-trace-record"), ("f", 2): (29, "repeated")}


def test_a_queue_that_was_used_up_leaves_the_fallback(spark):
    calls = [("f", i, 10 * i, 10 * i + 5, True, [6, 2 * i], None) for i in range(1, 4)]
    queues = [("f", 6, 1), ("f", 4, 1)]
    assert replayed(spark, calls, queues, 1000) == {("f", 1): (6, "replaced"), ("f", 2): (4, "replaced"), ("f", 3): (None, "missing-trace-record")}


def test_a_hot_queue_of_many_calls(spark):
    calls = [("f", i, 3 * i, 3 * i + 2, True, [7, 100 + i % 2], None) for i in range(300)]
    queues = [("f", 7, 1), *[("f", 100 + k, 1) for k in range(2)]]
    want = plain(calls, queues)
    assert replayed(spark, calls, queues, 20) == want
    assert sum(v[0] is not None for v in want.values()) == 3


def test_replay_of_nothing(spark):
    calls, queues = spark.createDataFrame([], CALLS), spark.createDataFrame([], QUEUES)
    assert vl.replay_calls(vl.call_options(calls, queues, ["file"], F.lit(True)), ["file"]).collect() == []


# Nested spans


def outermost(spans):
    taken = []
    for s, e in sorted(set(spans), key=lambda r: (r[0], -r[1])):
        if not any(s < b and a < e for a, b in taken):
            taken.append((s, e))
    return set(taken)


@pytest.mark.parametrize("limit", [1000, 2])
def test_outer_first(spark, limit):
    rng = random.Random(7)
    rows = [("touch", 0, 5), ("touch", 5, 9), ("touch", 5, 5), ("touch", 0, 0), ("equal", 1, 4), ("equal", 1, 4), ("inside", 0, 9), ("inside", 3, 3), ("inside", 2, 9)]
    rows += [("cross", 0, 10), ("cross", 5, 20), ("cross", 15, 25), ("cross", 22, 23), ("cross", 24, 30), (None, 2, 3)]
    for f in ("r1", "r2"):
        for _ in range(60):
            s = rng.randrange(200)
            rows.append((f, s, s + rng.choice([0, 1, 3, 9, 30])))
    got = sp.outer_first(spark.createDataFrame(rows, "file string, start long, end long"), ["file"], limit).collect()
    want = {(f, *span) for f in {r[0] for r in rows} for span in outermost([r[1:] for r in rows if r[0] == f])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_containment_of_nested_and_crossing_spans(spark):
    rows = [("f", 0, 10), ("f", 2, 5), ("f", 4, 8), ("f", 10, 12), ("f", 12, 12), ("f", 11, 11)]
    got = {(r.start, r.end): (r.outermost, r.crossing) for r in sp.containment(spark.createDataFrame(rows, "file string, start long, end long"), ["file"]).collect()}
    assert got == {(0, 10): (True, False), (2, 5): (False, False), (4, 8): (False, False), (10, 12): (True, False), (12, 12): (True, False), (11, 11): (False, False)}
    rows = [("f", 0, 10), ("f", 5, 15)]
    got = {r.start: (r.outermost, r.crossing) for r in sp.containment(spark.createDataFrame(rows, "file string, start long, end long"), ["file"]).collect()}
    assert got == {0: (True, False), 5: (False, True)}


def test_overlaps_of_spans_and_ranges_without_length(spark):
    pairs = [(s, e) for s in range(4) for e in range(s, 4)]
    frame = lambda rows: spark.createDataFrame([("f", *r) for r in rows], "file string, start long, end long")
    for ranges in ([(1, 1)], [(1, 1), (1, 1), (0, 3)], [(2, 2), (2, 3), (0, 2)], pairs):
        got = {(r.start, r.end): r.overlaps for r in sp.overlap_counts(frame(pairs), frame(ranges), ["file"], width=2).collect()}
        assert got == {(s, e): sum(a < e and s < b for a, b in ranges) for s, e in pairs}
    assert sp.without_overlap(frame([(5, 5)]), frame([(5, 5)]), ["file"]).count() == 1


def test_greedy_edits_without_ends(spark):
    rows = [("f", 0, 5, 1), ("f", None, 5, 9), ("f", 1, None, 9)]
    got = sp.select_edits(spark.createDataFrame(rows, "file string, start long, end long, priority int"), ["file"], 1).collect()
    assert [(r.start, r.end) for r in got] == [(0, 5)]


# Components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 1), (9, None)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges] + edges[:10]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {i: 300 for i in (300, 301, 302)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_choices_of_one_file():
    """Covered, used up, left, null and unknown: places of options by call."""
    calls = [(0, 10, True, ["a", "b"]), (5, 9, True, ["c"]), (10, 12, True, ["a", "b"]), (10, 11, None, [None, "c"]), (12, None, True, ["a"]), (None, 20, True, [])]
    starts, ends, typed, keys = map(list, zip(*calls))
    lists = [starts, ends, typed, [len(k) for k in keys], [k for known in keys for k in known], [True] * 8]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), *[pa.array([x]) for x in lists]], ["file", *"abcdef"])
    assert next(vl._chooser()([batch])).to_pylist() == [{"file": "f", "_choice": [0, -1, 1, -2, 1, 0]}]


def test_replay_of_a_full_file_is_one_pass(spark):
    """The longest file that one row replays, all calls with queues of their own: no state is copied call by call."""
    import time

    n = vl.FOLD_LIMIT
    calls = [(f"f{f}", i, i * 3, i * 3 + 2, True, [i, n + i, 2 * n + i], None) for f in range(40) for i in range(n)]
    queues = [(f"f{f}", k, 1) for f in range(40) for k in range(3 * n)]
    options = vl.call_options(spark.createDataFrame(calls, CALLS), spark.createDataFrame(queues, QUEUES), ["file"], F.lit(True), F.col("size"))
    options = options.localCheckpoint()
    start = time.time()
    assert vl.replay_calls(options, ["file"]).where("outcome = 'replaced' and matched_key = site").count() == 40 * n
    assert time.time() - start < 10


ODD_CALLS = [
    ("f", 1, 0, 30, True, [1], None), ("f", 2, 0, 0, True, [2, 3], None), ("f", 3, 5, 5, True, [2], None), ("f", 4, 10, None, True, [4], None), ("f", 5, None, 8, True, [5], None),
    ("f", None, 40, 45, True, [None, 6], None), ("f", 7, 41, 43, True, None, None), ("f", 8, 42, 44, False, [7], None), ("f", 9, 60, 50, True, [8], None), (None, 1, 0, 9, True, [1], 100), (None, 2, 3, 4, None, [2], 100),
]


def test_files_of_every_size_are_replayed_alike(spark):
    """Nested calls too tell the queue they would have taken; calls without length, start, end, name or file are where a plain walk has them."""
    rng = random.Random(21)
    calls = [("h", i, 2 * i, 2 * i + rng.choice([0, 1, 9, 40]), rng.random() < 0.8, [rng.randrange(4000) for _ in range(3)], None) for i in range(vl.FOLD_LIMIT + 200)]
    queues = [("h", k, 1 + k % 2) for k in range(4000)] + [(f, k, 1) for f in ("f", None) for k in range(1, 9)] + [("f", None, 2)]
    options = vl.call_options(spark.createDataFrame(ODD_CALLS + calls, CALLS), spark.createDataFrame(queues, QUEUES), ["file"], F.lit(True), F.col("size")).localCheckpoint()
    many, few = (sorted(map(repr, vl.replay_calls(options, ["file"], limit).collect())) for limit in (vl.FOLD_LIMIT, 7))
    assert many == few
    found = vl.replay_calls(options, ["file"]).where("file = 'h'").collect()
    nested = [r for r in found if r.outcome == "nested"]
    assert len(found) == len(calls) and len(nested) > 300 and all(r.matched_key is not None for r in nested)
    reach, used, want = -1, set(), {}
    for _, site, start, end, typed, keys, _ in sorted(calls, key=lambda c: (c[2], -c[3], c[1])):
        key = next((k for k in keys if k not in used), None)
        if start < reach:
            want[site] = (key, "nested")
            continue
        want[site] = (key, "missing-trace-record" if key is None else "unsupported-result-type" if not typed else "repeated" if key % 2 else "replaced")
        if key is not None and typed:
            used.add(key)
            reach = max(reach, end)
    assert {r.site: (r.matched_key, r.outcome) for r in found} == want


def test_a_queue_that_repeats_and_keys_of_another_type(spark):
    calls = spark.createDataFrame([("f", 1, 0, 5, True, [7, 8], None), ("f", 2, 6, 9, True, [8], None), ("f", 3, 10, 11, True, [], None)], CALLS.replace("array<long>", "array<int>"))
    queues = spark.createDataFrame([("f", 7, 1), ("f", 7, 2), ("f", 8, 0), ("f", 1 << 40, 3), ("f", None, 4)], QUEUES)
    found = vl.call_options(calls, queues, ["file"], F.col("records") == 1)
    assert dict(found.dtypes)["options"].startswith("array<struct<candidate:int,key:int,records:bigint")
    assert {r.site: [tuple(o) for o in r.options] for r in found.collect()} == {1: [(0, 7, 1, True, False), (0, 7, 2, False, False)], 2: [], 3: [(None, None, 4, False, False)]}


@pytest.mark.parametrize("limit", [1000, 1])
def test_a_nested_call_tells_its_queue_in_files_of_every_size(spark, limit):
    calls = spark.createDataFrame([("f", 1, 0, 50, True, [28], None), ("f", 2, 10, 30, True, [28, 29], None), ("f", 3, 0, 0, True, [29], None)], CALLS)
    options = vl.call_options(calls, spark.createDataFrame([("f", 28, 2), ("f", 29, 2)], QUEUES), ["file"], F.lit(True), F.col("size"))
    found = {r.site: (r.matched_key, r.candidate, r.records, r.outcome) for r in vl.replay_calls(options, ["file"], limit).collect()}
    assert found == {1: (28, 0, 2, "repeated"), 2: (29, 1, 2, "nested"), 3: (29, 0, 2, "nested")}


@pytest.mark.parametrize("query", ["callsite_lookup", "inline_outcomes", "inline_outcomes_by_kind"])
def test_calls_of_the_queries_move_once(spark, tmp_path, query):
    from cinderframe.checks import values as queries

    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    rng = random.Random(22)
    lines = [(i, rng.randrange(500), i % 9, 1 + i % 7, 1.0 + i % 50, rng.choice("ANR"), rng.choice("FO")) for i in range(600)]
    spark.createDataFrame(lines, kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = queries.QUERIES[query](spark, str(tmp_path))
    rows = found.collect()
    assert sum(getattr(r, "detected_calls", None) or getattr(r, "calls", None) or 1 for r in rows) == 600
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    # what a task has counted is summed up behind one more
    assert plan.count("+- Exchange ") == 1 + (query != "callsite_lookup") and plan.count("+- ReusedExchange ") == 1, plan


def test_rows_that_share_a_site_are_one_call_the_first(spark):
    rows = [("f", 1, 9, 12, True, [8], 100), ("f", 1, 2, 3, False, [7], None), ("f", 1, 2, 3, True, [6], None), ("f", 2, 0, 1, True, [7], None)]
    calls = spark.createDataFrame(rows, CALLS).coalesce(1)
    found = vl.call_options(calls, spark.createDataFrame([("f", k, 1) for k in (6, 7, 8)], QUEUES), ["file"], F.lit(True), F.col("size")).collect()
    assert {r.site: (r.start, r.end, r.typed, [(o.key, o.large) for o in r.options]) for r in found} == {1: (9, 12, True, [(6, False), (7, False), (8, True)]), 2: (0, 1, True, [(7, False)])}
