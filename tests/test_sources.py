"""Readers, sinks and streams on files."""

import json

import pytest
from pyspark.sql import functions as F

from cinderframe.operators import evidence as ev
from cinderframe.operators import telemetry as tm
from cinderframe.sources import reports as rp
from cinderframe.sources import telemetry as src
from cinderframe.sources import traces as tr
from cinderframe.sources.coverage import parse_coverage
from cinderframe.streaming import pipelines as st


def event(start, end, code, compile_ns, success=True, **extra):
    return {
        "start_wall_ns": start, "end_wall_ns": end, "result_code": code, "source_bytes": 100, "compile_success": success,
        "durations_ns": {"compile_ns": compile_ns, "total_ns": end - start}, "cpu_ns": {"children_user_ns": 60, "children_system_ns": 70}, **extra,
    }


def write(path, events, *more):
    path.write_text("".join(json.dumps(e) + "\n" for e in events) + "".join(m + "\n" for m in more))
    return str(path)


def read(spark, path, run=1):
    classified = src.classify_lines(src.read_lines(spark, path)).withColumn("run", F.lit(run))
    return classified, src.typed_events(classified, ["run"])


def test_summary_numbers(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [event(100, 300, 77, 80), event(200, 400, 1, 100, False)])
    _, events = read(spark, path)
    runs = spark.createDataFrame([(1, 10**9, 4)], "run int, wall_ns long, jobs int")
    r = tm.throughput(events, runs, ["run"]).first()
    assert (r["profiled_checks"], r["checks_per_second"]) == (2, 2.0)
    assert r["mean_in_flight"] == pytest.approx(4e-7) and r["utilization"] == pytest.approx(1e-7)
    assert tm.in_flight(events, ["run"]).first()["max_in_flight"] == 2
    stages = {s["stage"]: s for s in tm.stage_latency(events, ["run"]).collect()}
    assert len(stages) == 8
    assert (stages["compile_ns"]["samples"], stages["compile_ns"]["mean"]) == (1, 80.0)
    assert (stages["link_ns"]["samples"], stages["link_ns"]["median"]) == (0, 0.0)
    counts = {c["result_code"]: c["checks"] for c in tm.result_counts(events, ["run"]).collect()}
    assert counts == {77: 1, 1: 1}


def test_pooled_attempts(spark):
    second = 1_000_000_000
    rows = [(1, 1, 0, second, 77, True, 200_000_000), (1, 1, 0, second, -1, False, 9_000_000_000)]
    rows += [(1, 2, 4 * second, 5 * second, 77, True, 300_000_000)] * 3 + [(1, 3, 0, second, 77, True, 1)]
    events = spark.createDataFrame(
        rows, "run long, attempt int, start_wall_ns long, end_wall_ns long, result_code long, compile_success boolean, c long"
    ).withColumns({"compile_recorded": F.lit(True)})
    zero = [F.lit(0).cast("long").alias(n) for n in src.STAGE_NAMES if n not in ("compile_ns", "total_ns")]
    events = events.withColumn("durations_ns", F.struct(*zero, F.col("c").alias("compile_ns"), F.lit(second).alias("total_ns")))
    attempts = spark.createDataFrame([(1, 1, 2 * second, 5, 2), (1, 2, 3 * second, 0, 2)], "run long, attempt int, wall_ns long, returncode int, jobs int")
    r = tm.pooled_profile(events, attempts, "run", "attempt").first()
    assert (r["profiled_checks"], r["checks_per_second"], r["mean_in_flight"], r["utilization"]) == (5, 1.0, 1.0, 0.5)
    assert (r["compile_count"], r["compile_mean"], r["compile_median"], r["returncode"]) == (4, 275e6, 300e6, 0)


def test_tolerant_reader(spark, tmp_path):
    odd = ["not-json", "[1]", "3", "", "   ", '{"a": 1} tail', '{"start_wall_ns": "7", "source_bytes": 1.9, "result_code": "x"}']
    classified, events = read(spark, write(tmp_path / "b.jsonl", [event(1, 2, 77, 1)], *odd))
    assert classified.where("malformed").count() == 4
    rows = {r["start_wall_ns"]: r for r in events.collect()}
    assert rows[7]["source_bytes"] == 1 and rows[7]["result_code"] is None and rows[7]["compile_recorded"] is False
    assert rows[7]["cpu_ns"]["children_user_ns"] is None
    assert src.read_lines(spark, str(tmp_path / "absent.jsonl")).count() == 0


def test_append_and_read_back(spark, tmp_path):
    _, events = read(spark, write(tmp_path / "c.jsonl", [event(1, 2, 77, 5), event(3, 9, 1, 6, None)]))
    target = str(tmp_path / "log")
    src.append_events(events, target, ["run"])
    src.append_events(events, target, ["run"])
    classified, back = read(spark, target)
    assert classified.where("malformed").count() == 0
    assert sorted(map(repr, back.collect())) == sorted(map(repr, events.unionAll(events).collect()))


def test_coverage_counts(spark):
    lines = ["    1|     5|int x;", "    2|  1.2k|x", "    3|     0|dead", "    4|      |// note", "    5|1|}", "    6|#####|x", "7|-|x", "8|0.0k|x", "total 9"]
    got = parse_coverage(spark.createDataFrame([(1, l) for l in lines], "file int, line string"), ["file"]).collect()
    assert {r["line"] for r in got} == {1, 2, 3, 5, 6, 7, 8}
    assert {r["line"] for r in got if r["covered"]} == {1, 2, 5}


def test_trace_records_keep_file_order(spark, tmp_path):
    path = tmp_path / "trace"
    path.write_text("S 100000 1\nB 7 3 300 2\nS 100000 1e3\nR 7 12\nS 100000 \nX 1 2\nP 0x10 4\nS 9 " + "9" * 38 + "\nS 9 -0\n")
    lines = tr.read_trace_lines(spark, str(path))
    rows = tr.parse_records(lines, ["split", "row"]).orderBy("split", "row").collect()
    good = [r for r in rows if r["valid"]]
    assert len(rows) == 9 and len(good) == 7
    assert [(r["tag"], r["key"]) for r in good] == [("S", 100000), ("B", 7), ("S", 100000), ("R", 7), ("P", 16), ("S", 9), ("S", 9)]
    assert bytes(good[1]["payload"]) == bytes([44, 2, 0])
    assert good[2]["scalar_int"] == 1000 and good[5]["scalar_int"] == int("9" * 38)
    assert good[6]["scalar_int"] is None and good[6]["scalar_dbl"] == 0.0


def test_wide_records(spark):
    lines = ["V 100000 U 16 1 7", "V 5 U 64 2 18446744073709551615 1", "V 5 S 32 3 1 2", "V 5 Z 32 1 1", "V 5 S 8 1 x"]
    got = tr.parse_wide_records(spark.createDataFrame([(l,) for l in lines], "line string"), []).collect()
    assert [(r["key"], r["is_signed"], [int(v) for v in r["wide"]]) for r in got] == [
        (100000, False, [7]), (5, False, [18446744073709551615, 1])]


def test_alias_and_trace_payloads_are_checked(spark):
    frame = lambda text: spark.createDataFrame([(1, text)], "ref int, j string")
    pairs = rp.alias_pairs_from_json(frame('[["/b/x.c", "/a/x.c"], ["/a/x.c", "/b/x.c"]]'), "j").collect()
    assert [(p["a"], p["b"]) for p in pairs] == [("/a/x.c", "/b/x.c")]
    for bad in ('[["/a"]]', '[["a", "/b"]]', "{}"):
        with pytest.raises(Exception, match="absolute path pairs"):
            rp.alias_pairs_from_json(frame(bad), "j").collect()
    ok = '{"schema_version":1,"normalized_patterns":["t1","t2","t1"],"samples_completed":20}'
    got = rp.trace_set_from_json(frame(ok), "j", ["ref"]).collect()
    assert [(r["variant"], r["pattern"]) for r in got] == [(1, "t1"), (2, "t2")]
    for bad in ('{"schema_version":2,"normalized_patterns":["t"],"samples_completed":1}', '{"schema_version":1,"normalized_patterns":[],"samples_completed":1}'):
        with pytest.raises(Exception, match="invalid reference trace"):
            rp.trace_set_from_json(frame(bad), "j", ["ref"]).collect()


def test_verdict_precedence(spark):
    result, reason = ev.combine_rules([(n, F.col(n)) for n in ("a", "b", "c")])
    cases = [
        (("match", "match", "match"), ("match", None)),
        (("match", "missing_evidence", "mismatch"), ("mismatch", None)),
        (("missing_evidence", "match", "missing_evidence"), ("missing_evidence", "c")),
        (("missing_evidence", None, None), ("missing_evidence", "a")),
        ((None, None, "match"), ("match", None)),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, a string, b string, c string")
    got = df.select("i", result.alias("r"), reason.alias("w")).orderBy("i").collect()
    assert [(g["r"], g["w"]) for g in got] == [want for _, want in cases]


def test_alias_location_and_pairs(spark):
    files = spark.createDataFrame(
        [("/a/x.c", "one"), ("/b/x.c", "one"), ("/c/x.c", "two"), ("/b/y.c", "one")], "path string, content string")
    wanted = [("/a/x.c", "/b/x.c"), ("/a/x.c", "/c/x.c"), ("/a/x.c", "/b/y.c"), ("/b/x.c", "/a/x.c"), ("/a/x.c", "/none/x.c")]
    pairs = ev.verified_pairs(spark.createDataFrame(wanted, "reference string, candidate string"), files)
    assert [tuple(p) for p in pairs.collect()] == [("/a/x.c", "/b/x.c")]
    rows = [("/a/x.c:3:1", "/b/x.c:3:1"), ("/a/x.c:3:1", "/b/x.c:4:1"), ("/a/x.c:3:1", "/c/x.c:3:1")]
    got = ev.match_aliases(spark.createDataFrame(rows, "want string, got string"), pairs, "want", "got").collect()
    assert {(r["got"], r["alias_match"]) for r in got} == {(rows[0][1], True), (rows[1][1], False), (rows[2][1], False)}


def test_stream_ingest_equals_batch_over_several_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        write(source / f"{i}.jsonl", [event(i, i + 5, 77, i + 1)], "broken" if i else "")
    good, bad, check = (str(tmp_path / n) for n in ("good", "bad", "check"))
    lines = st.line_stream(spark, str(source)).withColumn("run", F.lit(1))
    st.start_ingest(lines, good, bad, check, ["run"]).awaitTermination()
    _, batch = read(spark, str(source))
    assert spark.read.parquet(good).drop("batch").exceptAll(batch).count() == 0
    assert spark.read.parquet(good).count() == batch.count() == 3
    assert spark.read.parquet(bad).count() == 2


def test_retry_state_across_batches(spark, tmp_path):
    source = tmp_path / "attempts"
    source.mkdir()
    schema = "candidate bigint, attempt bigint, result string"
    batches = [
        [(1, 1, "missing_evidence"), (2, 2, "match"), (3, 1, "mismatch")],
        [(1, 2, "match"), (2, 1, "missing_evidence"), (3, 2, "match"), (4, 1, "missing_evidence")],
        [(4, 3, "missing_evidence"), (4, 2, "missing_evidence"), (1, 3, "mismatch"), (5, 1, "missing_evidence")],
    ]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("".join(json.dumps(dict(zip(("candidate", "attempt", "result"), r))) + "\n" for r in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        st.run_to_folder(st.retry_verdicts(stream), out, check)
    got = {(r["candidate"], r["verdict"], r["attempts"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "match", 2), (2, "match", 2), (3, "mismatch", 1), (4, "missing_evidence", 3)}
    rows = spark.createDataFrame([r for b in batches for r in b], schema)
    batch = {(r["candidate"], r["verdict"], r["attempts"]) for r in ev.evidence_retry(rows, ["candidate"]).collect()}
    assert batch - got == {(5, "missing_evidence", 1)} and got <= batch


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, True), ("r", 2, None)], "ref string, mode int, ok boolean")
    out = str(tmp_path / "records")
    rp.write_json(df.select("ref", "mode", rp.tri_state(F.col("ok")).alias("ok")), out, ["ref", "mode"])
    rp.write_json(spark.createDataFrame([("r", 2, "no")], "ref string, mode int, ok string"), out, ["ref", "mode"])
    got = spark.read.json(out)
    assert {(r["mode"], r["ok"], r["schema_version"]) for r in got.collect()} == {(1, "yes", 1), (2, "no", 1)}
