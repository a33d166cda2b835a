"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderframe.session import written


def components(edges: DataFrame, kind: str = "components") -> DataFrame:
    """node and root, the smallest node of its component, for every node of `edges` (a, b).

    Both star steps are aggregates and joins on a node, so neither a component nor the links of a node are ever gathered in one
    place; the number of rounds grows with the logarithm of a component's diameter. Links with a null end or of a node with itself
    are left out.
    """
    state = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), kind)
    before = None
    while True:
        found = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not found[0] or found == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = found
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        state = written(small.select("e.u", "e.v").filter("u <> v").distinct(), kind)
