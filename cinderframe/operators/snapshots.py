"""Which accepted candidate a run would fall back to when its time is up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CLOSING_WINDOW_NS = 240 * 1_000_000_000


def in_closing_window(t_ns: Column, deadline_ns: Column, window_ns: int = CLOSING_WINDOW_NS) -> Column:
    return t_ns >= deadline_ns - window_ns


def closing_snapshot(checks: DataFrame, keys: list[str], window_ns: int = CLOSING_WINDOW_NS) -> DataFrame:
    """Content of the latest accepted check inside the closing window of its run.

    `checks`: `t_ns`, `deadline_ns`, `accepted`, `content`. Works on streams in update mode as well.
    """
    usable = checks.where(
        F.col("accepted") & in_closing_window(F.col("t_ns"), F.col("deadline_ns"), window_ns)
    )
    return usable.groupBy(*keys).agg(
        F.max_by("content", F.struct("t_ns", "content")).alias("content"), F.max("t_ns").alias("t_ns")
    )
