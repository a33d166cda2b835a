"""Compute a costly column once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections and filters refer to instead of repeating them.

    The optimizer moves filters below a projection and copies the projected expression into them, so
    parsing would run once per filter and once more for the result. The output of a generator is not
    copied. Its one-element array costs nothing next to the parsing.
    """
    value = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(value)))
