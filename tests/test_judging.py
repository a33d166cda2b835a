"""The verdict pipeline on small reports."""

import pytest
from pyspark.sql import functions as F

from cinderframe.operators import evidence as ev
from cinderframe.operators import reports as rp
from cinderframe.operators.telemetry import depth_stability
from cinderframe.plans.pipelines import judge_candidates, profile_runs

HARNESS = "/work/h.cpp"


def report(frames, message="/src/lib.cc:7:3: runtime error: division by 0"):
    lines = [message] if message else []
    lines += [f"    #{i} 0x{i + 16:x} in {n} {p}:{l}:3" for i, (n, p, l) in enumerate(frames)]
    lines.append(f"    #{len(frames)} 0xff in LLVMFuzzerTestOneInput {HARNESS}:5:1")
    return "\n".join(lines) + "\n"


LIB = "/src/lib.cc"
A = [("crash", LIB, 7), ("via_a", LIB, 12)]
B = [("crash", LIB, 7), ("via_b", LIB, 15), ("run", LIB, 20)]
COPY = [(n, "/copy/lib.cc", l) for n, _, l in A]
OTHER = [("crash", LIB, 7), ("third", LIB, 22)]


SAMPLES = "ref string, sample int, status int, harness string, text string"
GOOD = [(0, 77, report(A)), (1, 77, report(B))]


def judge(spark, attempts, pairs=None, symbolize=True, samples=GOOD, runs=1, **given):
    known = spark.createDataFrame([("r", n, s, HARNESS, t) for n, s, t in samples], SAMPLES)
    rows = [("r", c, n, s, HARNESS, t) for c, n, s, t in attempts]
    candidates = spark.createDataFrame(rows, "ref string, candidate int, attempt int, status int, harness string, text string")
    got = judge_candidates(known, candidates, ["ref"], ["candidate"], F.lit(symbolize), pairs=pairs, runs=runs, **given).collect()
    return {r["candidate"]: (r["verdict"], r["attempts"]) for r in got}


def test_retry_and_precedence(spark):
    bare = "/src/lib.cc:7:3: runtime error: division by 4\n"
    got = judge(
        spark,
        [
            (1, 1, 77, bare), (1, 2, 77, report(B)),
            (2, 1, 77, bare), (2, 2, 77, bare), (2, 3, 77, bare), (2, 4, 77, report(A)),
            (3, 1, 77, report(OTHER)), (3, 2, 77, report(A)),
            (4, 1, 1, report(A)),
            (5, 1, 77, report(A, "/src/lib.cc:8:3: runtime error: division by 0")),
            (6, 1, 77, report(A, "/src/lib.cc:7:3: runtime error: division by 99")),
        ],
    )
    assert got == {
        1: ("match", 2), 2: ("missing_evidence", 3), 3: ("mismatch", 1), 4: ("mismatch", 1), 5: ("mismatch", 1), 6: ("match", 1),
    }


def test_approved_copies_match_in_message_location_and_trace(spark):
    moved = report(COPY, "/copy/lib.cc:7:3: runtime error: division by 0")
    wrong = report([COPY[0], ("via_x", "/copy/lib.cc", 12)], "/copy/lib.cc:7:3: runtime error: division by 0")
    later = report([COPY[0], ("via_a", "/copy/lib.cc", 13)], "/copy/lib.cc:7:3: runtime error: division by 0")
    attempts = [(1, 1, 77, moved), (2, 1, 77, wrong), (3, 1, 77, later), (4, 1, 77, report(A))]
    pairs = spark.createDataFrame([("/copy/lib.cc", LIB)], "a string, b string")
    unrelated = spark.createDataFrame([("/copy/lib.cc", "/else/lib.cc")], "a string, b string")
    assert judge(spark, attempts, pairs) == {1: ("match", 1), 2: ("mismatch", 1), 3: ("mismatch", 1), 4: ("match", 1)}
    assert judge(spark, attempts, unrelated)[1] == ("mismatch", 1)


def test_order_partitions_and_duplicates_do_not_matter(spark):
    attempts = [(c, n, 77, t) for c in range(6) for n, t in ((1, report([], None)), (2, report(A if c % 2 else OTHER)))]
    first = judge(spark, attempts)
    assert judge(spark, list(reversed(attempts))) == first
    assert judge(spark, attempts + attempts) == first


def test_profile_is_written_as_json_and_text(spark, tmp_path):
    line = '{"start_wall_ns":%d,"end_wall_ns":%d,"result_code":77,"source_bytes":9,"durations_ns":{"total_ns":2000000}}'
    (tmp_path / "log").write_text("\n".join([line % (1, 5), line % (3, 9), "oops"]) + "\n")
    runs = spark.createDataFrame([(1, 10**9, 2)], "run int, wall_ns long, jobs int")
    out, text = str(tmp_path / "out"), str(tmp_path / "text")
    profile_runs(spark, str(tmp_path / "log"), runs, F.lit(1), out, text)
    totals = spark.read.json(f"{out}/totals").first()
    assert (totals["profiled_checks"], totals["max_in_flight"], totals["malformed_event_lines"]) == (2, 2, 1)
    assert spark.read.json(f"{out}/latency").count() == 8
    lines = [r["value"] for r in spark.read.text(text).collect()]
    assert "Tester total before cleanup           2    2.000      2.000    2.000    2.000    2.000" in lines


def test_profile_of_runs_in_one_file(spark, tmp_path):
    line = '{"start_wall_ns": %d, "end_wall_ns": %d, "result_code": 77, "durations_ns": {"total_ns": 2000000}}'
    (tmp_path / "log").write_text("\n".join(["1\t" + line % (1, 5), "2\t" + line % (3, 9), "1\t" + line % (2, 4), "2\toops", "2\t  ", "1\ta\tb"]) + "\n")
    runs = spark.createDataFrame([(1, 10**9, 2), (2, 10**9, 2)], "run long, wall_ns long, jobs int")
    run, record = F.substring_index("line", "\t", 1).cast("long"), F.expr(r"substring(line, instr(line, '\t') + 1)")
    out, text = str(tmp_path / "out"), str(tmp_path / "text")
    profile_runs(spark, str(tmp_path / "log"), runs, run, out, text, record)
    found = {r["run"]: (r["profiled_checks"], r["max_in_flight"], r["malformed_event_lines"]) for r in spark.read.json(f"{out}/totals").collect()}
    assert found == {1: (2, 2, 1), 2: (1, 1, 1)}


def test_profile_query_writes_few_files(spark, tmp_path, monkeypatch):
    from cinderframe.checks import telemetry as checks

    spark.range(400).selectExpr(
        "id as event_id", "timestamp_micros(id * 1000000) as ts", "id % 200 as user_id", "'click' as event_type", "1.5D as value", "'' as props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(checks, "new_folder", lambda _, name: f"{tmp_path}/{name}")
    assert checks.profile_runs(spark, str(tmp_path)).count() == 200
    assert len(list((tmp_path / "log").rglob("part-*"))) <= spark.sparkContext.defaultParallelism


# References


def captured(spark, samples, runs, hints=None):
    rows = [("r", n, s, HARNESS, t) for n, s, t in samples] + [(None, 0, 77, HARNESS, report(A)), ("other", 0, 77, HARNESS, report(B)), ("other", 1, 77, HARNESS, report(B))]
    parsed = rp.parse_reports(spark.createDataFrame(rows, SAMPLES))
    reference = {r.ref: r for r in ev.capture_reference(parsed, ["ref"], runs=runs, hints=hints).collect()}
    traces = {(r.ref, r.fingerprint) for r in ev.build_trace_set(parsed, ["ref"], runs=runs).collect()}
    assert set(reference) == {"r", None, "other"}
    return reference["r"], len({f for ref, f in traces if ref == "r"}), parsed


MOVED = report([("crash", LIB, 8), ("via_a", LIB, 12)])
CHANGED = report(A, "/src/lib.cc:7:3: runtime error: signed integer overflow")


@pytest.mark.parametrize(
    "samples, runs, rejected, strict, traces",
    [
        ([(0, 77, report(A)), (1, 77, report(A)), (2, 77, report(A))], 2, None, True, 1),
        ([(0, 77, report(A)), (1, 77, report(B)), (2, 77, report(A))], 2, None, False, 2),
        ([(0, 77, report(A)), (1, 77, report(A)), (2, 1, "no crash")], 2, None, False, 0),  # a sample failed
        ([(0, 77, report(A)), (1, 77, report(A))], 2, None, False, 0),  # a sample is absent
        ([(0, 77, report(A)), (2, 77, report(A)), (3, 77, report(A))], 2, None, False, 0),  # the right number of the wrong samples
        ([(0, 77, report(A))], 0, None, False, 1),  # a single report is no proof of a stable depth
        ([(0, 77, report(A)), (1, 77, report(A)), (2, 77, report(A)), (3, 1, "not expected")], 2, None, True, 1),
        ([(0, 1, "no crash"), (1, 77, report(A)), (2, 77, report(A))], 2, "no crash", False, 0),
        ([(1, 77, report(A)), (2, 77, report(A))], 2, "no crash", False, 0),
        ([(0, 77, report([], None)), (1, 77, report(A))], 1, "no signature", False, 0),
        ([(0, 77, report([("crash", HARNESS, 9)], "/work/h.cpp:9:3: runtime error: division by 0")), (1, 77, report(A))], 1, "harness fault", False, 0),
        ([(0, 77, report(A)), (1, 77, report([("crash", HARNESS, 9), ("via_a", LIB, 12)], "/src/lib.cc:7:3: runtime error: division by 0"))], 1, None, True, 0),
        ([(0, 77, report(A)), (1, 77, MOVED)], 1, None, True, 0),  # the location changed
        ([(0, 77, report(A)), (1, 77, CHANGED)], 1, None, True, 0),  # the signature changed
    ],
)
def test_samples_that_reject_a_reference(spark, samples, runs, rejected, strict, traces):
    reference, known, _ = captured(spark, samples, runs)
    assert (reference.rejected, reference.depth_strict, known) == (rejected, strict, traces)
    assert (reference.ref_signature is None) == (rejected is not None)


def test_strictness_is_that_of_the_depth_record(spark):
    for samples in (GOOD, [(0, 77, report(A)), (1, 77, report(A))], [(0, 77, report(A)), (1, 1, "")]):
        reference, _, parsed = captured(spark, samples, 1)
        grid = ev.expected_samples(parsed.where("ref = 'r'"), ["ref"], runs=1)
        expected = next(r.depth for r in grid.collect() if r.sample == 0)
        runs = grid.where("sample > 0").select("ref", F.col("sample").alias("run"), "depth", F.lit(expected).alias("expected_depth"), (~(F.coalesce("status", F.lit(0)) == 77)).alias("failed"), F.lit(1).alias("wall_ns"))
        assert depth_stability(runs, ["ref"]).first().stable == reference.depth_strict


def test_hints_choose_the_library_site(spark):
    lines = "\n".join(["/src/lib.cc:7:3: runtime error: division by 0"] + [f"    #{i} 0x1{i}  ({lib}+0x{i}f)" for i, lib in enumerate(["/lib/libc.so.6", "/opt/liba.so.1", "/opt/libb.so.2"])]) + "\n"
    kind = "ref string, exact_paths array<string>, exact_names array<string>, stems array<string>, allow_fallback boolean"
    cases = [(None, "/opt/liba.so.1"), (([], ["libb.so.2"], [], False), "/opt/libb.so.2"), (([], [], ["libb.so"], True), "/opt/libb.so.2"), (([], [], ["libz.so"], True), "/opt/liba.so.1"), (([], [], ["libz.so"], False), None)]
    for hint, library in cases:
        hints = None if hint is None else spark.createDataFrame([("r", *hint)], kind)
        assert captured(spark, [(0, 77, lines)], 0, hints)[0].ref_library == library


def test_candidates_of_a_rejected_reference_match_nothing(spark):
    assert judge(spark, [(1, 1, 77, report(A))], samples=[(0, 1, "no crash"), (1, 77, report(A))]) == {1: ("mismatch", 1)}
    assert judge(spark, [(1, 1, 77, report(A))]) == {1: ("match", 1)}


def test_own_rules_replace_the_checks(spark):
    """Only status and depth count, and a report without frames lacks evidence."""

    def rules(symbolize):
        depth = F.when(F.col("depth") == 0, ev.MISSING).when(F.col("depth") == F.col("ref_depth"), ev.MATCH).otherwise(ev.MISMATCH)
        return [("status", F.when(F.col("status") == 77, ev.MATCH).otherwise(ev.MISMATCH)), ("own depth", depth)]

    attempts = [(1, 1, 77, report(OTHER)), (2, 1, 77, report(B)), (3, 1, 77, "nothing"), (3, 2, 77, report(A, None)), (4, 1, 1, report(A))]
    got = judge(spark, attempts, rules=rules)
    assert got == {1: ("match", 1), 2: ("mismatch", 1), 3: ("match", 2), 4: ("mismatch", 1)}


def test_trace_sets_are_built_over_all_samples(spark, monkeypatch):
    """Samples beyond the expected ones, here none, one and two, take part; an expected one that is absent still counts."""
    from cinderframe.checks import evidence as queries

    kinds = "report_id long, ref_id long, role string, status int, signature struct<kind string, value string>, location string, canonical string, fingerprint string, harness_fault string"
    row = lambda report, ref, trace, status=77, location="a.c:1", role="sample": (report, ref, role, status, ("asan", "SEGV"), location, trace, trace, None)
    rows = [row(1, 3, "x"), row(2, 3, "x"), row(3, 3, "y"), row(4, 6, "x"), row(5, 6, "x", 1), row(6, 9, "x"), row(7, 9, "x", location="b.c:2"), row(8, 7, "x")]
    rows += [row(9, 12, "z"), row(10, 12, "w", 1, role="candidate"), row(11, 4, "x"), row(12, 4, "y"), row(13, 4, "z")]
    monkeypatch.setattr(queries, "_parsed", lambda *given: spark.createDataFrame(rows, kinds))
    found = sorted(tuple(r) for r in queries.trace_set_build(spark, "").collect())
    assert found == [(3, 1, "x", 0), (3, 2, "y", 2), (4, 1, "x", 0), (4, 2, "y", 1), (4, 3, "z", 2), (12, 1, "z", 0)]
    samples = queries._samples(queries._parsed())
    assert ev.expected_samples(samples, ["ref_id"], runs=0).count() == 6
    assert ev.expected_samples(samples, ["ref_id"], runs=0, beyond=True).count() == len(rows) - 1
