"""Sinks and JSON payloads for summaries, stability records, alias pairs and trace sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCHEMA_VERSION = 1


def tri_state(value: Column) -> Column:
    return F.when(value.isNull(), "not-evaluated").when(value, "yes").otherwise("no")


def write_json(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Overwrite a JSON data set with the columns in name order and a schema version.

    With `keys`, only the partitions present in `df` are replaced.
    """
    ordered = df.select(*sorted(df.columns)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    writer = ordered.write.mode("overwrite")
    if keys:
        writer = writer.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def alias_pairs_from_json(df: DataFrame, payload: str) -> DataFrame:
    """`[["/a", "/b"], …]` to rows `(a, b)` with a <= b; anything but pairs of absolute paths is an error."""
    parsed = F.from_json(F.col(payload), "array<array<string>>")
    valid = parsed.isNotNull() & F.forall(
        parsed, lambda p: (F.size(p) == 2) & F.forall(p, lambda s: F.coalesce(s.startswith("/"), F.lit(False)))
    )
    checked = F.when(valid, parsed).otherwise(
        F.raise_error(F.lit("source aliases must be a list of absolute path pairs"))
    )
    pairs = df.select(F.explode(checked).alias("p"))
    return pairs.select(F.array_min("p").alias("a"), F.array_max("p").alias("b")).distinct()


def alias_pair_json(a: Column, b: Column) -> Column:
    """One sorted pair as a JSON array."""
    return F.to_json(F.sort_array(F.array(a, b)))


def trace_set_from_json(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Rows `(keys, variant, pattern)` of a version-1 trace set, first occurrences in order."""
    parsed = F.from_json(
        F.col(payload), "schema_version int, normalized_patterns array<string>, samples_completed int"
    )
    patterns = parsed["normalized_patterns"]
    valid = (
        (parsed["schema_version"] == SCHEMA_VERSION)
        & (F.size(patterns) > 0)
        & F.forall(patterns, lambda p: F.coalesce(F.trim(p) != "", F.lit(False)))
        & (parsed["samples_completed"] >= 0)
    )
    checked = F.when(F.coalesce(valid, F.lit(False)), F.array_distinct(patterns)).otherwise(
        F.raise_error(F.lit("invalid reference trace payload"))
    )
    return df.select(*keys, F.posexplode(checked).alias("variant", "pattern")).withColumn(
        "variant", F.col("variant") + 1
    )
