"""Latency, concurrency and throughput of candidate checks, per run or any other keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.plans.scan import exact_summary, null_safe_join
from cinderframe.session import written
from cinderframe.sources.telemetry import BUILD_STAGES, STAGE_NAMES, STAGES

SUMMARY = ("samples", "mean", "median", "p95", "min", "max")
# Ten seconds of distinct instants per cell of the in-flight scan.
INSTANTS_PER_CELL_NS = 10_000_000_000


def _stage_values(events: DataFrame, keys: list[str]) -> DataFrame:
    """Long form `(keys, stage, ns)` with NULL for durations that are no sample."""
    failed_build = F.col("compile_recorded") & ~F.col("compile_success")

    def sample(name: str) -> Column:
        ns = F.col("durations_ns")[name]
        usable = (ns > 0) & ~failed_build if name in BUILD_STAGES else ns > 0
        return F.struct(F.lit(name).alias("stage"), F.when(usable, ns).alias("ns"))

    return events.select(*keys, F.inline(F.array(*[sample(name) for name in STAGE_NAMES])))


def stage_samples(events: DataFrame, keys: list[str]) -> DataFrame:
    """Positive durations per stage; build stages only of successful builds."""
    return _stage_values(events, keys).where(F.col("ns").isNotNull())


def _zero_filled(summary: DataFrame) -> DataFrame:
    zero = {name: F.coalesce(F.col(name), F.lit(0).cast("long")) for name in ("samples", "p95", "min", "max")}
    zero |= {name: F.coalesce(F.col(name), F.lit(0.0)) for name in ("mean", "median")}
    return summary.withColumns(zero)


def stage_latency(events: DataFrame, keys: list[str]) -> DataFrame:
    """One summary row per key and stage; stages without samples show zeros."""
    return _zero_filled(exact_summary(_stage_values(events, keys), [*keys, "stage"], "ns"))


def stage_pivot(latency: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """One row per key with one column per stage."""
    return latency.groupBy(*keys).pivot("stage", list(STAGE_NAMES)).agg(F.first(value))


def size_cpu_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of source size and child CPU time. Zeros count here."""
    pairs = F.array(
        F.struct(F.lit("source_bytes").alias("metric"), F.col("source_bytes").alias("value")),
        F.struct(F.lit("user_ns").alias("metric"), F.col("cpu_ns.children_user_ns").alias("value")),
        F.struct(F.lit("system_ns").alias("metric"), F.col("cpu_ns.children_system_ns").alias("value")),
    )
    return exact_summary(events.select(*keys, F.inline(pairs)), [*keys, "metric"], "value")


SIZES_AND_CPU = ("source_bytes", "user_ns", "system_ns")


def metric_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """One summary row per key and metric: the stages, source size and child CPU time, all in one pass over the events.

    Samples of all metrics are counted as (metric, value), so they share one exchange and one selection of ranks. Metrics without samples
    show zeros.
    """
    failed_build = F.col("compile_recorded") & ~F.col("compile_success")

    def stage(name: str) -> Column:
        ns = F.col("durations_ns")[name]
        usable = (ns > 0) & ~failed_build if name in BUILD_STAGES else ns > 0
        return F.when(usable, ns)

    samples = {name: stage(name) for name in STAGE_NAMES}
    samples |= dict(zip(SIZES_AND_CPU, (F.col("source_bytes"), F.col("cpu_ns.children_user_ns"), F.col("cpu_ns.children_system_ns"))))
    pairs = [F.struct(F.lit(name).alias("metric"), value.cast("long").alias("value")) for name, value in samples.items()]
    return _zero_filled(exact_summary(events.select(*keys, F.inline(F.array(*pairs))), [*keys, "metric"], "value"))


def result_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Checks per integer result code; records without one are left out here."""
    return (
        events.where(F.col("result_code").isNotNull())
        .groupBy(*keys, "result_code")
        .agg(F.count(F.lit(1)).alias("checks"))
    )


def _timed(events: DataFrame) -> DataFrame:
    total = F.col("durations_ns.total_ns")
    return events.where(
        F.col("start_wall_ns").isNotNull()
        & F.col("end_wall_ns").isNotNull()
        & total.isNotNull()
        & (F.col("end_wall_ns") >= F.col("start_wall_ns"))
    )


def in_flight_changes(events: DataFrame, keys: list[str]) -> DataFrame:
    """Net change of running checks per instant.

    Ends at an instant come before starts, so only the level after the instant can be a new
    maximum, and one net row per instant is enough.
    """
    points = F.array(
        F.struct(F.col("start_wall_ns").alias("t"), F.lit(1).alias("d")),
        F.struct(F.col("end_wall_ns").alias("t"), F.lit(-1).alias("d")),
    )
    return (
        _timed(events)
        .select(*keys, F.inline(points))
        .groupBy(*keys, "t")
        .agg(F.sum("d").alias("net"))
        .withColumn("_cell", F.floor(F.col("t") / F.lit(INSTANTS_PER_CELL_NS)).cast("long"))
    )


def _levels(changes: DataFrame, keys: list[str]) -> tuple[DataFrame, Window]:
    upto = (
        Window.partitionBy(*keys, "_cell").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return changes.withColumn("_level", F.sum("net").over(upto)), before


def in_flight(events: DataFrame, keys: list[str]) -> DataFrame:
    """Largest number of checks running at once."""
    local, before = _levels(in_flight_changes(events, keys), keys)
    cells = local.groupBy(*keys, "_cell").agg(
        F.sum("net").alias("_net"), F.max("_level").alias("_peak")
    )
    peaks = cells.withColumn("_top", F.col("_peak") + F.coalesce(F.sum("_net").over(before), F.lit(0)))
    return peaks.groupBy(*keys).agg(F.greatest(F.lit(0), F.max("_top")).alias("max_in_flight"))


def in_flight_series(events: DataFrame, keys: list[str]) -> DataFrame:
    """Number of running checks after each instant at which it was touched."""
    changes = in_flight_changes(events, keys)
    local, before = _levels(changes, keys)
    carried = (
        changes.groupBy(*keys, "_cell")
        .agg(F.sum("net").alias("_net"))
        .select(*keys, "_cell", F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_carry"))
    )
    return null_safe_join(local, carried, [*keys, "_cell"]).select(
        *keys, "t", (F.col("_level") + F.col("_carry")).alias("level")
    )


def throughput(events: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Checks per second, mean checks in flight and worker utilisation against `runs(wall_ns, jobs)`."""
    usable = (
        F.col("start_wall_ns").isNotNull()
        & (F.col("end_wall_ns") >= F.col("start_wall_ns"))
        & F.col("durations_ns.total_ns").isNotNull()
    )
    busy = F.greatest(F.lit(0), F.col("durations_ns.total_ns")).cast("decimal(38,0)")
    counted = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("profiled_checks"),
        F.coalesce(F.sum(F.when(usable, busy)), F.lit(0)).alias("_busy"),
    )
    joined = null_safe_join(runs, counted, keys, "left")
    checks = F.coalesce(F.col("profiled_checks"), F.lit(0).cast("long"))
    wall = F.col("wall_ns")
    mean = F.when(wall > 0, F.coalesce(F.col("_busy"), F.lit(0)).cast("double") / wall).otherwise(F.lit(0.0))
    return joined.select(
        *keys,
        wall,
        checks.alias("profiled_checks"),
        F.when(wall > 0, checks / (wall / F.lit(1e9))).otherwise(F.lit(0.0)).alias("checks_per_second"),
        mean.alias("mean_in_flight"),
        F.when(F.col("jobs") > 0, mean / F.col("jobs")).otherwise(F.lit(0.0)).alias("utilization"),
    )


def pool_attempts(events: DataFrame, attempts: DataFrame, run: str, attempt: str) -> tuple[DataFrame, DataFrame]:
    """Raw samples of all attempts that wrote a summary, and one run row with the walls added up.

    `attempts` has one row per attempt with `wall_ns` and `returncode`; an attempt without a row
    never started and does not count.
    """
    runs = attempts.groupBy(run).agg(
        F.sum("wall_ns").alias("wall_ns"),
        F.max_by("returncode", attempt).alias("returncode"),
        F.count(F.lit(1)).alias("attempts"),
        F.max("jobs").alias("jobs"),
    )
    pooled = events.join(attempts.select(run, attempt), [run, attempt])
    return pooled, runs


_POOLED = ("start_wall_ns", "end_wall_ns", "result_code", "source_bytes", "compile_recorded", "compile_success", "durations_ns", "cpu_ns")
# What a log need not measure.
_MEASURED = {"source_bytes": "long", "cpu_ns": "struct<children_user_ns:long,children_system_ns:long>"}


def pooled_summary(events: DataFrame, attempts: DataFrame, run: str, attempt: str) -> tuple[DataFrame, DataFrame]:
    """Run rows and metric rows over the pooled samples of a run's attempts; samples are joined with the attempts once."""
    pooled, runs = pool_attempts(events, attempts, run, attempt)
    absent = {name: F.lit(None).cast(kind) for name, kind in _MEASURED.items() if name not in pooled.columns}
    pooled = written(pooled.withColumns(absent).select(run, *_POOLED), "pooled")
    speed = throughput(pooled, runs, [run])
    joined = null_safe_join(speed, runs.select(run, "returncode", "attempts"), [run])
    joined = null_safe_join(joined, in_flight(pooled, [run]), [run], "left")
    joined = joined.withColumn("max_in_flight", F.coalesce("max_in_flight", F.lit(0)))
    return joined, metric_summary(pooled, [run])


def pooled_profile(events: DataFrame, attempts: DataFrame, run: str, attempt: str) -> DataFrame:
    """One row per run and metric over the pooled samples of its attempts; what holds for the run is on each of its rows,
    so are count, mean and median of its builds."""
    totals, metrics = pooled_summary(events, attempts, run, attempt)
    profile = null_safe_join(totals, metrics, [run], "left")
    of_builds = lambda c: F.max(F.when(F.col("metric") == "compile_ns", F.col(c))).over(Window.partitionBy(run))
    return profile.select("*", *[of_builds(c).alias(f"compile_{name}") for c, name in (("samples", "count"), ("mean", "mean"), ("median", "median"))])


def summary_records(totals: DataFrame, metrics: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """One nested record per key: `reducer` figures with counts by result code, and a summary for each metric by name.

    The lists have one entry for each metric and each result code that occurs.
    """
    figures = F.struct(*SUMMARY)
    timing = metrics.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("metric", figures.alias("figures")))).alias("_m"))
    codes = results.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("result_code", "checks"))).alias("_c"))
    joined = null_safe_join(null_safe_join(totals, timing, keys, "left"), codes, keys, "left")
    of = lambda keep: F.map_from_entries(F.transform(F.filter("_m", keep), lambda m: F.struct(m["metric"], m["figures"])))
    stage = lambda m: m["metric"].isin(*STAGE_NAMES)
    counts = F.transform(F.coalesce("_c", F.array().cast(codes.schema["_c"].dataType)), lambda c: F.struct(c["result_code"].cast("string"), c["checks"]))
    reducer = [c for c in totals.columns if c not in keys]
    return joined.select(
        *keys,
        F.struct(*reducer, F.map_from_entries(counts).alias("result_counts")).alias("reducer"),
        of(stage).alias("candidate_timing"),
        of(lambda m: ~stage(m)).alias("sizes_and_cpu"),
    )


def timeout_calibration(
    samples: DataFrame,
    keys: list[str],
    position: str,
    elapsed_ms: str,
    bad: Column,
    default_ms: int = 300_000,
    floor_ms: int = 2_000,
    ceiling_ms: int = 60_000,
    multiplier: int = 8,
    warmup: int = 1,
) -> DataFrame:
    """Execution timeout from probe runs: slowest probe after warm-up, times a factor, within bounds.

    A probe that failed or left no time, or too few probes, gives the default.
    """
    slowest = F.max(F.when(F.col(position) > warmup, F.col(elapsed_ms)))
    unusable = F.coalesce(F.bool_or(bad | F.col(elapsed_ms).isNull()), F.lit(False))
    scaled = F.least(F.greatest(slowest * multiplier, F.lit(floor_ms)), F.lit(ceiling_ms))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("probes"),
        F.when(unusable | (F.count(F.lit(1)) <= warmup), F.lit(default_ms))
        .otherwise(scaled)
        .cast("long")
        .alias("timeout_ms"),
    )


def depth_stability(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all reproduced runs show the expected stack depth.

    `runs`: `run, depth, expected_depth, failed, wall_ns`. A failed run makes the record unstable and
    hides the runs after it.
    """
    failed = F.col("failed")
    first_failed = runs.where(failed).groupBy(*keys).agg(F.min("run").alias("failed_run"))
    seen = null_safe_join(runs, first_failed, keys, "left")
    counted = F.col("failed_run").isNull() | (F.col("run") < F.col("failed_run"))
    depth = F.when(counted, F.col("depth"))
    return seen.groupBy(*keys).agg(
        F.sort_array(F.collect_set(depth)).alias("depths"),
        F.coalesce(
            F.bool_and(F.when(counted, F.col("depth") == F.col("expected_depth")))
            & (F.count(depth) > 0)
            & F.first("failed_run").isNull(),
            F.lit(False),
        ).alias("stable"),
        F.max("expected_depth").alias("expected_depth"),
        F.first("failed_run").alias("failed_run"),
        F.coalesce(F.sum(F.col("wall_ns").try_cast("long")), F.lit(0).cast("long")).alias("wall_ns"),
    )


def mode_totals(records: DataFrame, keys: list[str]) -> DataFrame:
    """Wall time over all modes of a reference; a wall that is no integer counts as nothing."""
    total = F.coalesce(F.sum(F.col("wall_ns").try_cast("long")), F.lit(0).cast("long"))
    return records.groupBy(*keys).agg(
        total.alias("total_wall_ns"), (total / F.lit(1e9)).alias("total_wall_seconds")
    )


def attempt_status(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome of a run from its first attempt and, at most, one retry.

    `attempts`: `attempt` (1 or 2), `validated`, `diagnosis` (of the first attempt, why a retry was or
    was not started).
    """
    first = F.max(F.when(F.col("attempt") == 1, F.col("validated")))
    retry = F.max(F.when(F.col("attempt") == 2, F.col("validated")))
    diagnosis = F.max(F.when(F.col("attempt") == 1, F.col("diagnosis")))
    status = (
        F.when(first, F.lit("not-needed"))
        .when(retry.isNull(), F.coalesce(diagnosis, F.lit("normal")))
        .when(retry, F.lit("recovered"))
        .otherwise(F.lit("retry-validation-failed"))
    )
    return attempts.groupBy(*keys).agg(
        status.alias("status"),
        F.when(first, F.lit(1)).when(retry.isNull(), F.lit(1)).otherwise(F.lit(2)).alias("attempt_count"),
        F.coalesce(F.when(first, F.lit(True)).otherwise(retry), F.lit(False)).alias("final_validated"),
    )


def _ms(ns: Column) -> Column:
    return F.format_string("%.3f", ns.cast("double") / F.lit(1e6))


def summary_in_ms(latency: DataFrame, keys: list[str]) -> DataFrame:
    """The latency table as report text: milliseconds with three decimals, stages by label."""
    label = F.create_map(*[F.lit(part) for pair in STAGES for part in pair])
    return latency.select(
        *keys,
        F.coalesce(label[F.col("stage")], F.col("stage")).alias("stage"),
        "samples",
        *[_ms(F.col(name)).alias(f"{name}_ms") for name in SUMMARY[1:]],
    )


def render_summary(latency_ms: DataFrame, keys: list[str]) -> DataFrame:
    """One fixed-width text line per stage."""
    line = F.format_string(
        "%-34s  %3d  %7s  %9s  %7s  %7s  %7s",
        "stage", "samples", "mean_ms", "median_ms", "p95_ms", "min_ms", "max_ms",
    )
    return latency_ms.select(*keys, line.alias("value"))
