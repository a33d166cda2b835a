"""Line coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COVERAGE_LINE = r"^\s*(\d+)\|\s*([^|]*)\|"
ZERO_COUNT = r"^0+(?:\.0+)?[kMGTPE]?$"
# Count texts that also mean "not covered".
UNCOVERED_MARKS = ("-", "#####")


def parse_coverage(report_lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """`number|count|source` lines to `(keys, line, executable, covered)`, one row per source line.

    A blank count means the line is not executable; such lines and all other text are left out.
    """
    found = report_lines.where(F.col(line).rlike(COVERAGE_LINE)).select(
        *keys,
        F.regexp_extract(line, COVERAGE_LINE, 1).try_cast("long").alias("number"),
        F.trim(F.regexp_extract(line, COVERAGE_LINE, 2)).alias("count"),
    )
    covered = ~(F.col("count").isin(*UNCOVERED_MARKS) | F.col("count").rlike(ZERO_COUNT))
    return (
        found.where(F.col("count") != "")
        .groupBy(*keys, F.col("number").alias("line"))
        .agg(F.lit(True).alias("executable"), F.bool_or(covered).alias("covered"))
    )
