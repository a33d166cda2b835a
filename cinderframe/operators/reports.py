"""Sanitizer reports to evidence columns, all candidates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderframe.functions import frames as fr
from cinderframe.functions import signatures as sg
from cinderframe.plans.pin import pin


def with_blocks(reports: DataFrame, text: str = "text") -> DataFrame:
    """Add `block`, the frames of the first stack trace."""
    return pin(reports, block=fr.first_block(F.col(text)))


def with_traces(reports: DataFrame, harness: str = "harness", match_basename: bool = True) -> DataFrame:
    """Add `trace`, the canonical frames before the harness, from `block`."""
    return pin(reports, trace=fr.pre_entry_frames(F.col("block"), F.col(harness), match_basename))


def parse_reports(
    reports: DataFrame, text: str = "text", harness: str = "harness", match_basename: bool = True
) -> DataFrame:
    """Evidence columns of every report; the report text itself is dropped before any shuffle."""
    marked = pin(with_blocks(reports, text), _marks=fr.frame_marks(F.col("block"), F.col(harness), match_basename))
    traced = pin(marked, canonical=fr.canonical_trace(fr.canonical_frames(F.col("_marks"))))
    return traced.select(
        *[c for c in reports.columns if c != text],
        fr.stack_depth(F.col("block")).alias("depth"),
        "canonical",
        fr.fingerprint(F.col("canonical")).alias("fingerprint"),
        fr.marked_location(F.col("_marks")).alias("location"),
        fr.marked_owner(F.col(text), F.col("_marks"), F.col(harness)).alias("harness_fault"),
        fr.library_sites(F.col("block")).alias("sites"),
        sg.crash_signature(F.col(text)).alias("signature"),
        sg.all_signatures(F.col(text)).alias("signatures"),
    )


def explode_frames(blocks: DataFrame, keys: list[str], array: str = "block") -> DataFrame:
    """One row per frame with its parsed fields."""
    return blocks.select(*keys, F.explode(fr.frame_structs(F.col(array))).alias("f")).select(*keys, "f.*")


def first_frames(frames: DataFrame, keys: list[str], rule) -> DataFrame:
    """First frame per report that satisfies `rule`; map-side combined, so a hot report is no problem."""
    rest = [c for c in frames.columns if c not in keys]
    return (
        frames.where(rule)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "pos").alias("f"))
        .select(*keys, "f.*")
    )
