"""Candidate-check telemetry: JSON lines in, typed events out, and back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderframe.plans.pin import pin

# Measured stages of one check, in report order, with their labels.
STAGES = (
    ("python_import_ns", "Python imports/module setup"),
    ("argument_setup_ns", "Argument parsing/candidate setup"),
    ("compile_ns", "Compile subprocess"),
    ("compile_link_ns", "Direct compile+link subprocess"),
    ("link_ns", "Link subprocess"),
    ("execute_ns", "Candidate execution region"),
    ("oracle_ns", "Crash-oracle checks"),
    ("total_ns", "Tester total before cleanup"),
)
STAGE_NAMES = tuple(name for name, _ in STAGES)
BUILD_STAGES = ("compile_ns", "compile_link_ns")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a telemetry log with the `file` they come from; a log not there yet has none."""
    try:
        return spark.read.text(path).select(
            F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line string, file string")


def _integer(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "bigint")


def _has(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant").isNotNull()


def _is_object(record: Column) -> Column:
    return F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))


def classify_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add `record` (a VARIANT) and `malformed`; blank lines are dropped.

    A line counts as malformed when it is not one JSON object. The parser accepts text after a value,
    so the line is parsed as the first element of an array whose second is the line's own hash: a
    line torn into two records, or with anything behind its object, does not reach that element.
    """
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    mark = F.xxhash64(text)
    framed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = F.try_variant_get(framed, "$[1]", "bigint") == mark
    record = F.when(whole, F.try_variant_get(framed, "$[0]", "variant"))
    parsed = pin(lines.where(F.col(line).rlike(r"\S")), record=record)
    return parsed.withColumn("malformed", ~_is_object(F.col("record")))


def typed_events(classified: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Well-formed records as typed columns; a field that is no integer becomes NULL."""
    record = F.col("record")
    success = F.try_variant_get(record, "$.compile_success", "variant")
    cpu = F.try_variant_get(record, "$.cpu_ns", "variant")

    def cpu_part(name: str) -> Column:
        path = f"$.cpu_ns.{name}"
        value = F.when(_has(record, path), _integer(record, path)).otherwise(F.lit(0).cast("long"))
        return F.when(_is_object(cpu), value)

    user = cpu_part("children_user_ns")
    durations = F.struct(
        *[_integer(record, f"$.durations_ns.{name}").alias(name) for name in STAGE_NAMES]
    )
    return classified.where(~F.col("malformed")).select(
        *(keep or []),
        _integer(record, "$.start_wall_ns").alias("start_wall_ns"),
        _integer(record, "$.end_wall_ns").alias("end_wall_ns"),
        _integer(record, "$.result_code").alias("result_code"),
        _integer(record, "$.source_bytes").alias("source_bytes"),
        success.isNotNull().alias("compile_recorded"),
        F.coalesce(
            (F.schema_of_variant(success) == "BOOLEAN")
            & F.try_variant_get(record, "$.compile_success", "boolean"),
            F.lit(False),
        ).alias("compile_success"),
        durations.alias("durations_ns"),
        F.struct(
            user.alias("children_user_ns"),
            F.when(user.isNotNull(), cpu_part("children_system_ns")).alias("children_system_ns"),
        ).alias("cpu_ns"),
    )


def record_json(events: DataFrame) -> Column:
    """One compact JSON record per event, with the recorded field names and schema version."""
    flat = [c for c in events.columns if c not in ("compile_recorded",)]
    fields = [F.col(c) for c in flat if c != "compile_success"]
    success = F.when(F.col("compile_recorded"), F.col("compile_success")).alias("compile_success")
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), *fields, success))


def append_events(events: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Append one JSON line per event. Each task writes its own files, so lines never interleave."""
    lines = events.select(record_json(events.drop(*(keys or []))).alias("value"))
    lines.write.mode("append").text(path)
