"""Ordered scans and selections against plain Python, with hot keys and tiny cells."""

import math
import random
import statistics

from pyspark.sql import functions as F

from cinderframe.operators import spans as sp
from cinderframe.operators import telemetry as tm
from cinderframe.operators import values as vl
from cinderframe.plans.scan import chunk_of, exact_summary, number_rows, running_max, running_sum


def hot_rows(seed, n=600):
    """A third of the rows share one key; NULL is a key of its own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        rows.append((key, i, rng.randint(-50, 1000)))
    return rows


def by_key(rows):
    groups = {}
    for k, p, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((p, v))
    return groups


def test_running_scans_cross_cell_borders(spark):
    rows = hot_rows(1)
    df = spark.createDataFrame(rows, "k string, p long, v long")
    chunk = chunk_of(F.col("p"), 7)
    summed = running_sum(df, ["k"], ["p"], chunk, F.col("v"), "s", inclusive=False)
    topped = running_max(summed, ["k"], ["p"], chunk, F.col("v"), "m", inclusive=False)
    got = number_rows(topped, ["k"], ["p"], chunk, "n").collect()
    assert len(got) == len(rows)
    want = {}
    for k, items in by_key(rows).items():
        total, top = 0, None
        for n, (p, v) in enumerate(items, 1):
            want[p] = (k, total, top, n)
            total, top = total + v, v if top is None else max(top, v)
    assert {r["p"]: (r["k"], r["s"], r["m"], r["n"]) for r in got} == want


def test_exact_summary(spark):
    rng = random.Random(2)
    rows = hot_rows(2) + [("one", 0, 5)] + [("wide", i, rng.randint(1, 10**15)) for i in range(401)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {r["k"]: r for r in exact_summary(df, ["k"], "v").collect()}
    groups = {}
    for k, _, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        r = got[k]
        assert (r["samples"], r["min"], r["max"]) == (len(values), min(values), max(values))
        assert r["median"] == statistics.median(values)
        assert r["p95"] == sorted(values)[max(0, math.ceil(0.95 * len(values)) - 1)]
        assert math.isclose(r["mean"], statistics.fmean(values), rel_tol=1e-12)


def test_percentile_rank_for_every_small_count(spark):
    rows = [(n, v) for n in range(1, 130) for v in range(1, n + 1)]
    got = exact_summary(spark.createDataFrame(rows, "n long, v long"), ["n"], "v").collect()
    assert all(r["p95"] == max(1, math.ceil(0.95 * r["n"])) for r in got)


def test_in_flight_matches_a_sweep(spark):
    rng = random.Random(3)
    rows = []
    for run in (1, 2):
        for _ in range(200):
            start = rng.randint(0, 60) * 10**9
            rows.append((run, start, start + rng.randint(0, 20) * 10**9))
    events = spark.createDataFrame(rows, "run long, start_wall_ns long, end_wall_ns long").withColumn(
        "durations_ns", F.struct(F.lit(1).cast("long").alias("total_ns"))
    )
    got = {r["run"]: r["max_in_flight"] for r in tm.in_flight(events, ["run"]).collect()}
    for run in (1, 2):
        points = sorted(p for r, s, e in rows if r == run for p in ((s, 1), (e, -1)))
        level = top = 0
        for _, d in points:
            level += d
            top = max(top, level)
        assert got[run] == top


def greedy(edits):
    chosen = []
    for p, s, e in sorted(set(edits), key=lambda x: (-x[0], -(x[2] - x[1]), x[1])):
        if all(e <= cs or s >= ce for _, cs, ce in chosen):
            chosen.append((p, s, e))
    return chosen


def test_greedy_selection_by_folds_and_by_rounds(spark):
    rng = random.Random(4)
    rows = []
    for f in range(12):
        for _ in range(40 if f else 150):
            s = rng.randint(0, 400)
            rows.append((f, rng.choice([70, 80, 95]), s, s + rng.randint(1, 60)))
    df = spark.createDataFrame(rows, "file long, priority long, start long, end long")
    want = {(f, *e) for f in range(12) for e in greedy([r[1:] for r in rows if r[0] == f])}
    for limit in (1000, 5):
        got = [(r["file"], r["priority"], r["start"], r["end"]) for r in sp.select_edits(df, ["file"], limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_overlap_counts_with_tiny_cells(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.choice([1, 1, 2]), s := rng.randint(0, 99), s + rng.randint(1, 30)) for _ in range(n)]
    spans, ranges = make(120), make(80)
    frame = lambda rows: spark.createDataFrame(rows, "file long, start long, end long")
    got = sp.overlap_counts(frame(spans), frame(ranges), ["file"], width=8).collect()
    want = {s: sum(r[0] == s[0] and r[1] < s[2] and s[1] < r[2] for r in ranges) for s in spans}
    assert {(r["file"], r["start"], r["end"]): r["overlaps"] for r in got} == want


def test_span_flags_over_many_blocks(spark):
    rng = random.Random(6)
    lines = [(1, n, True, rng.random() < 0.1) for n in rng.sample(range(0, 700), 150)]
    spans = [(1, s, s + rng.choice([0, 3, 70, 300])) for s in range(0, 600, 5)]
    coverage = spark.createDataFrame(lines, "file long, line long, executable boolean, covered boolean")
    got = sp.span_flags(spark.createDataFrame(spans, "file long, start long, end long"), coverage, ["file"]).collect()
    for r in got:
        inside = [c for _, n, _, c in lines if r["start"] <= n <= r["end"]]
        assert (r["has_executable"], r["has_covered"]) == (bool(inside), any(inside))
    assert len(got) == len(set(spans))


def test_edits_are_bytes(spark):
    docs = spark.createDataFrame([(1, "añb/*x*/ü"), (2, "same")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 3, "N"), (1, 4, 9, "")], "doc_id long, start long, end long, replacement string")
    got = {r["doc_id"]: r["text"] for r in sp.apply_edits(docs, edits, "doc_id").collect()}
    assert got == {1: "aNbü", 2: "same"}


def test_unknown_marker_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a M1; M2; b")], "doc_id long, text string")
    known = spark.createDataFrame([(1, "M1", "int x")], "doc_id long, marker string, definition string")
    try:
        sp.restore_markers(docs, known, "doc_id", r"M\d").collect()
        raise AssertionError("expected an error")
    except Exception as error:
        assert "unknown marker: M2" in str(error)
    relaxed = sp.restore_markers(docs, known, "doc_id", r"M\d", strict=False)
    assert relaxed.first()["text"] == "a int x; M2; b"


def test_queue_runs_dry_in_order(spark):
    calls = spark.createDataFrame([("S", 1, n) for n in (10, 20, 30)], "tag string, key long, seq long")
    records = spark.createDataFrame([("S", 1, 5, "x"), ("S", 1, 9, "y"), ("R", 1, 1, "z")], "tag string, key long, seq long, value string")
    got = vl.pair_in_order(calls, records, ["tag", "key"], "seq", "value", chunk=chunk_of(F.col("seq"), 4)).orderBy("seq")
    assert [(r["value"], r["status"]) for r in got.collect()] == [("x", "ok"), ("y", "ok"), (None, "exhausted")]


def test_scans_over_a_hot_key_with_positions_far_apart(spark):
    """Every row is a cell of its own, and the cells of the hot key fall into many cells of cells."""
    far = 1 << 20
    rows = [("hot" if i % 3 else None, i * far - 500 * far, i % 17) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, p long, v long").withColumn("p", F.col("p") * (1 << 10))
    got = running_max(running_sum(df, ["k"], ["p"], chunk_of(F.col("p")), F.col("v"), "s"), ["k"], ["p"], chunk_of(F.col("p")), F.col("v"), "m", inclusive=False)
    want = {}
    for key in ("hot", None):
        total, top = 0, None
        for k, p, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total += v
            want[p << 10] = (k, total, top)
            top = v if top is None else max(top, v)
    assert {r["p"]: (r["k"], r["s"], r["m"]) for r in got.collect()} == want


def test_a_scan_reads_once_and_exchanges_rows_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).select((F.col("id") % 3).alias("k"), "id", F.lit("x" * 20).alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    scanned = number_rows(df, ["k"], ["id"], chunk_of(F.col("id"), 100), "n")
    assert scanned.agg(F.max("n")).first()[0] == 1667
    scanned.collect()
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
    assert sum("Exchange hashpartitioning" in line and "_cell" in line and "REPARTITION_BY_COL" in line and "Reused" not in line for line in final.splitlines()) == 1


def test_percentiles_by_radix_rounds(spark):
    """Values so close together that they share their leading bits, and others that share none."""
    rng = random.Random(11)
    rows = [("near", 2**62 + rng.randrange(10**9)) for _ in range(300)] + [("negative", -(2**61) - rng.randrange(10**12)) for _ in range(301)]
    rows += [("spread", rng.choice([-1, 1]) * rng.randrange(2 ** rng.randint(1, 63))) for _ in range(500)] + [("ties", rng.choice([5, 5, 5, 2**40])) for _ in range(99)]
    rows += [("none", None), (None, 7), (None, None)]
    # wanted ranks in neighbouring buckets, with a border inside a block of bits
    rows += [("border", v) for v in (*range(1_000, 1_012), *range(1_013, 1_023))]
    df = spark.createDataFrame(rows, "k string, v long")
    for ordered in (1, 1 << 12):
        got = {r["k"]: r for r in exact_summary(df, ["k"], "v", ordered).collect()}
        assert set(got) == {"near", "negative", "spread", "ties", "none", "border", None}
        for k, r in got.items():
            values = sorted(v for key, v in rows if key == k and v is not None)
            assert r["samples"] == len(values)
            if values:
                assert (r["min"], r["max"], r["p95"]) == (values[0], values[-1], values[max(0, math.ceil(0.95 * len(values)) - 1)])
                assert math.isclose(r["median"], statistics.median(values), rel_tol=1e-12)
            else:
                assert r["median"] is None and r["p95"] is None
