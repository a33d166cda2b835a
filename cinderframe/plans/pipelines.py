"""End-to-end jobs: the profile of a set of runs, and the judgement of candidate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderframe.operators import evidence as ev
from cinderframe.operators import reports as rp
from cinderframe.operators import telemetry as tm
from cinderframe.plans.scan import null_safe_join
from cinderframe.session import written
from cinderframe.sources.reports import write_json, write_text
from cinderframe.sources.telemetry import classify_lines, read_lines, typed_events


def profile_runs(
    spark: SparkSession, log: str, runs: DataFrame, run: Column, summary_path: str, text_path: str, record: Column | None = None
) -> dict[str, DataFrame]:
    """Telemetry log to summary tables, written as JSON and as report text.

    `run` is the run key of a line as an expression over `line` and `file`; `record` is what of the line is the check's record, the
    whole line if not given. So one file may hold the lines of many runs. `runs` has `run, wall_ns, jobs`. The log is parsed once.
    """
    lines = read_lines(spark, log).withColumn("run", run)
    classified = classify_lines(lines if record is None else lines.withColumn("line", record))
    malformed = classified.groupBy("run").agg(F.count_if("malformed").alias("malformed_event_lines"))
    events = written(typed_events(classified, ["run"]), "events")
    latency = tm.stage_latency(events, ["run"])
    totals = null_safe_join(tm.throughput(events, runs, ["run"]), tm.in_flight(events, ["run"]), ["run"], "left")
    totals = null_safe_join(totals, malformed, ["run"], "left")
    tables = {
        "totals": totals,
        "latency": latency,
        "sizes": tm.size_cpu_summary(events, ["run"]),
        "results": tm.result_counts(events, ["run"]),
    }
    for name, table in tables.items():
        write_json(table, f"{summary_path}/{name}")
    write_text(tm.render_summary(tm.summary_in_ms(latency, ["run"]), ["run"]), text_path)
    return tables


def judge_candidates(
    samples: DataFrame,
    candidates: DataFrame,
    keys: list[str],
    candidate: list[str],
    symbolize: Column,
    max_attempts: int = ev.CANDIDATE_ATTEMPTS,
    pairs: DataFrame | None = None,
    runs: Column | int = ev.STABILITY_RUNS,
    hints: DataFrame | None = None,
    rules=None,
) -> DataFrame:
    """One verdict per candidate from the reports of its attempts.

    `samples`: reference reports with `sample` (0 is the initial one, `runs` are expected behind it), `status`, `harness`, `text`;
    `candidates`: the same with `attempt` instead. `hints` name the libraries of a reference, `rules` replaces the evidence
    checks (see `evidence.verdict`). Each text is parsed once; what is written and shuffled are the evidence columns.
    """
    reference = written(rp.parse_reports(samples), "reference")
    evidence = rp.parse_reports(candidates)
    if pairs is not None:
        evidence = written(evidence, "candidates")
    checked = ev.verdict(
        evidence,
        ev.capture_reference(reference, keys, runs=runs, hints=hints),
        ev.build_trace_set(reference, keys, runs=runs),
        keys,
        symbolize,
        rules=rules,
        keep=[*keys, *candidate, "attempt"],
        pairs=pairs,
        report=[*candidate, "attempt"],
    )
    return ev.evidence_retry(checked, [*keys, *candidate], max_attempts)
