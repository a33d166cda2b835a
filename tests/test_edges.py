"""Single cases that once ended a job or changed an answer."""

import random
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation
from fractions import Fraction

from pyspark.sql import functions as F

from cinderframe.functions.scalars import compare_digits, integer_digits, parse_integer, scalar_fields
from cinderframe.operators.evidence import match_trace_set
from cinderframe.operators.spans import apply_edits, select_edits
from cinderframe.sources.telemetry import classify_lines
from cinderframe.streaming.pipelines import beat, heartbeats, retry_verdicts, run_to_folder, snapshot_changes


def test_wide_and_zero_padded_radix_integers(spark):
    texts = ["0xfffffffffffffffff", "-0x" + "f" * 30, "0x" + "f" * 31, "0b" + "0" * 70 + "1", "0o" + "7" * 40, "0x0", "0xff", "-0b101", "9" * 38, "9" * 39]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_integer(F.col("t")).alias("v")).collect()
    want = [16**17 - 1, -(16**30) + 1, None, 1, 8**40 - 1, 0, 255, -5, 10**38 - 1, None]
    assert [None if r.v is None else int(r.v) for r in rows] == want


def test_edit_without_replacement_removes_text_only(spark):
    documents = spark.createDataFrame([("d", "abcdef")], "file string, text string")
    edits = spark.createDataFrame([("d", 2, 4, None)], "file string, start long, end long, replacement string")
    assert apply_edits(documents, edits, "file").first()["text"] == "abef"


def test_trace_set_under_a_null_key(spark):
    reports = spark.createDataFrame([(None, "t", 7), ("r", "t", 8)], "ref string, canonical string, fingerprint long")
    known = spark.createDataFrame([(None, 7, 1), ("r", 7, 1)], "ref string, fingerprint long, variant int")
    rows = match_trace_set(reports, known, ["ref"]).collect()
    assert {r.ref: r.variant for r in rows} == {None: 1, "r": None}


def test_torn_lines_are_malformed(spark):
    good = ['{"a":1}', ' {"a":{"b":[1,2]}} ', '{"a":"}{"}', "{}"]
    torn = ['{"a":1}{"a":2}', '{"a":1} x}', '{"a":1},{"a":2}', '{"a":1},0]{}', '{"a":1', "[1]", "3", "null", '{"a":1}]', "x}"]
    rows = classify_lines(spark.createDataFrame([(t,) for t in [*good, *torn, " "]], "line string")).select("line", "malformed").collect()
    assert {r.line: r.malformed for r in rows} == {**dict.fromkeys(good, False), **dict.fromkeys(torn, True)}


def test_snapshot_changes_do_not_depend_on_arrow_batches(spark, tmp_path):
    rows = [(1, t, t % 7) for t in range(200, 0, -1)]
    spark.createDataFrame(rows, "run long, t_ns long, content long").coalesce(1).write.parquet(str(tmp_path / "in"))
    limit, found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size in ("10", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            stream = spark.readStream.schema("run long, t_ns long, content long").parquet(str(tmp_path / "in"))
            run_to_folder(snapshot_changes(stream), str(tmp_path / f"out{size}"), str(tmp_path / f"mark{size}"))
            found.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out{size}")).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert found[0] == found[1] == sorted(rows)


def test_edit_selection_does_not_depend_on_the_fold_limit(spark):
    far = 2**45
    edits = [
        ("inside", 0, 10, 9), ("inside", 5, 5, 1), ("inside", 10, 10, 1), ("inside", 0, 0, 3),
        ("wins", 0, 10, 1), ("wins", 5, 5, 9), ("wins", 2, 4, 5),
        ("points", 0, 9, 1), ("points", 5, 5, 2), ("points", 5, 5, 3), ("points", 7, 7, 1),
        ("far", 0, far, 1), ("far", far - 5, far - 1, 9), ("far", far - 4, far + 3, 2),
    ]
    df = spark.createDataFrame(edits, "file string, start long, end long, priority int")
    folded, rounds = (sorted(map(tuple, select_edits(df, ["file"], limit).select(*df.columns).collect())) for limit in (1000, 1))
    assert rounds == folded
    assert set(folded) == set(edits) - {edits[1], edits[4], edits[7], edits[11], edits[13]}


def test_integers_of_any_length(spark):
    rng = random.Random(3)
    texts = ["0x0", "-0x0", "-0", "+0x10", "0o17", "-0b101", "00", "01", "1.50e1", "1.5", "-2.0", "x", "", "0x", "1e0", "0.0e5", "-1e-3", "12e-1", "120e-1"]
    texts += [f"{sign}{prefix}{''.join(rng.choice(letters) for _ in range(n))}" for sign in ("", "-") for n in (30, 31, 40, 41, 97) for prefix, letters in (("0x", "0123456789abcdefABCDEF"), ("0o", "01234567"), ("0b", "01"), ("7", "0123456789"))]
    texts += ["0x1" + "0" * 64, "0x" + "f" * 64, f"{10**40}", f"1{'0' * 50}e-10", "5e60", "-3.25e45", hex(10**9), hex(10**18), hex(10**27), hex(10**45)]

    def plain(text):
        try:
            return str(int(text, 0))
        except ValueError:
            pass
        try:
            value = Decimal(text)
        except InvalidOperation:
            return None
        exact = Fraction(value) if value.is_finite() else Fraction(1, 2)
        return str(exact.numerator) if exact.denominator == 1 else None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", integer_digits(F.col("t")).alias("d"), scalar_fields(F.col("t")).alias("s")).collect()
    assert {r.t: r.d for r in rows} == {t: plain(t) for t in texts}
    for r in rows:
        zero = r.d == "0" and r.t.startswith("-")
        assert r.s.digits == (None if zero else r.d)
        assert r.s.kind == ("int" if r.d is not None and not zero else "decimal" if r.t in ("-0", "-0x0", "1.5", "-1e-3", "12e-1") else None)
        if r.d is not None:
            assert r.s.real == float(int(r.d))


def test_digits_against_bounds(spark):
    numbers = [0, 1, -1, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 2**63 - 1, 2**63, -(2**63), 10**41, -(10**41)]
    df = spark.createDataFrame([(str(n),) for n in numbers], "d string")
    for bound in (-1, 0, 2**31 - 1, -(2**31) - 1, 2**63 - 1):
        assert [r[0] for r in df.select(compare_digits(F.col("d"), bound)).collect()] == [n <= bound for n in numbers]


def test_idle_runs_are_forgotten_and_silent_candidates_told(spark, tmp_path):
    """Streams in steps: each step is a file, processed to the end with the same checkpoint."""
    source, beats = str(tmp_path / "in"), str(tmp_path / "beats")
    for t, run in ((0, 1), (10_000, 2), (20_000, 1), (20_100, 1)):
        spark.createDataFrame([(run, (1_700_000_000 + t) * 10**9, 7)], "run long, t_ns long, content long").write.mode("append").parquet(source)
        accepted = spark.readStream.schema("run long, t_ns long, content long").parquet(source)
        run_to_folder(snapshot_changes(accepted, idle_s=3600, delay="0 seconds"), str(tmp_path / "out"), str(tmp_path / "mark"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.run, r.t_ns // 10**9 - 1_700_000_000) for r in rows) == [(1, 0), (1, 20_000), (2, 10_000)]

    tried = str(tmp_path / "tried")
    at = datetime(2024, 1, 1)
    first = [(1, 1, "missing_evidence", at), (2, 2, "match", at), (3, 1, "match", at), (4, 3, "missing_evidence", at)]
    spark.createDataFrame(first, "candidate long, attempt int, result string, at timestamp").write.parquet(tried)
    attempts = spark.readStream.schema("candidate long, attempt int, result string, at timestamp").parquet(tried)
    told = []
    for hours in (0, 3):
        beat(spark, beats, at + timedelta(hours=hours))
        stream = retry_verdicts(attempts, time="at", patience_s=3600, delay="1 minute", beats=heartbeats(spark, beats))
        run_to_folder(stream, str(tmp_path / "told"), str(tmp_path / "told-mark"))
        told.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / "told")).collect())))
    assert told[0] == [(3, "match", 1)]
    assert told[1] == [(1, "missing_evidence", 1), (2, "match", 2), (3, "match", 1), (4, "missing_evidence", 3)]
