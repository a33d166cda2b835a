"""Exact duplicates by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cinderframe.llm.common import WHITE
from cinderframe.session import written

#: Bytes of the first digit; every later digit covers as many bytes as all before it together, times three.
DIGIT = 64


def _without_white_space(text: Column) -> Column:
    return reduce(lambda column, mark: F.replace(column, F.lit(mark), F.lit("")), WHITE, text)


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digit: int = DIGIT) -> DataFrame:
    """Rows with equal texts, white space aside: doc_id, keep_id, group_size, kept, text_sha256.

    All documents are split by length and leading bytes, then each remaining group by its next bytes, until it holds one
    document or its texts have ended. Only bytes are compared, never digests (text_sha256 is an output column). A digit
    grows with its position, so a text of n bytes takes about log4(n / 64) rounds, and a document leaves with the round
    that sets it apart; most leave with the first. A round counts its groups with map-side sums and joins the counts of
    groups of two or more back, a join whose large keys adaptive execution splits, so no group has to fit one task.

    Of equal texts, the row with the most code points in the original, then the smallest id, stays. A null text equals
    an empty one; all empty texts are one group. A null id sorts before every other. Rows that repeat the id of the row that
    stays are the same document and stay with it. An empty table gives an empty result.
    """
    original = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), original.alias("original"))
    rows = rows.select("id", F.length("original").alias("n_chars"), _without_white_space(F.col("original")).alias("plain"))
    body = F.col("plain").cast("binary")
    state = rows.select(
        "id", "n_chars", F.sha2(body, 256).alias("sha"), F.octet_length("plain").cast("long").alias("n_bytes"), body.alias("body"),
    ).withColumn("group", F.col("n_bytes"))
    at, width, done = 0, digit, []
    while True:
        chunk = F.substring("body", at + 1, width)
        state = state.withColumn("chunk", chunk)
        shared = state.groupBy("group", "chunk").count().filter("count > 1")
        shared = written(shared.select("group", "chunk", F.monotonically_increasing_id().alias("next")), "radix-groups")
        # always by shuffle: the shared digits grow with the documents, and one plan serves every size
        joined = state.join(shared.hint("merge"), ["group", "chunk"], "left")
        more = F.col("next").isNotNull() & (F.col("n_bytes") > at + width)
        joined = joined.select("id", "n_chars", "sha", "n_bytes", F.col("next").alias("group"), more.alias("open"), F.when(more, F.col("body")).alias("body"))
        table = written(joined, "radix-round")
        done.append(table.filter(~F.col("open")).select("id", "n_chars", "sha", F.lit(at).alias("round"), "group"))
        state = table.filter("open").drop("open")
        at, width = at + width, 3 * (at + width)
        if state.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, done)
    groups = rows.filter("group is not null").groupBy("round", "group").agg(
        F.min(F.struct(-F.col("n_chars"), F.col("id"))).getField("id").alias("keep_id"), F.count("*").alias("group_size"), F.lit(True).alias("shared")
    )
    rows = rows.join(groups, ["round", "group"], "left")
    keep = F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("id"))
    return rows.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )
