"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from cinderframe.session import written


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (smallest node of the component) for every node of `edges` `(a, b)`.

    Every node points at the smallest node it has heard of; in turn, its larger neighbours and then all its
    neighbours are told. Both steps are aggregates and joins on a node, so no component and no node's
    list of neighbours is gathered anywhere. The number of rounds grows with the logarithm of a
    component's diameter; each is written, and only its row count and checksum reach the driver. Edges with a NULL
    end or of a node with itself are left out.
    """
    state, arrows = _told(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("next")).distinct())
    seen = None
    while state["rows"] and state != seen:
        seen = state
        # larger neighbours learn a node's smallest one
        around = arrows.select("node", "next").unionByName(arrows.select(F.col("next").alias("node"), F.col("node").alias("next")))
        lowest = around.groupBy("node").agg(F.min("next").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = around.join(lowest, "node").where(F.col("next") > F.col("node"))
        large = large.select(F.col("next").alias("node"), F.col("low").alias("next")).where("node <> next").distinct()
        # smaller neighbours and the node itself learn it too
        lowest = large.groupBy("node").agg(F.min("next").alias("low"))
        told = large.join(lowest, "node").select(F.inline(F.array(F.struct(F.col("next").alias("node"), F.col("low").alias("next")), F.struct(F.col("node"), F.col("low").alias("next")))))
        state, arrows = _told(told.where("node <> next").distinct())
    return arrows.select("node", F.col("next").alias("root")).unionByName(
        arrows.select(F.col("next").alias("node"), F.col("next").alias("root")).distinct()
    )


def _told(arrows: DataFrame) -> tuple[dict, DataFrame]:
    """The arrows as a written table, and the row count and checksum that were seen while writing."""
    state = Observation()
    total = F.sum(F.xxhash64("node", "next").cast("decimal(38,0)"))
    table = written(arrows.observe(state, F.count(F.lit(1)).alias("rows"), total.alias("sum")), "stars")
    return state.get, table
