"""Shards of near equal bytes: sampled splitters, range partition, overfull ranges subdivided."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from cinderframe.session import written

#: Ranges drawn for each shard, and sampled keys for each range.
RANGES, SAMPLES = 16, 16
LOWEST = -(2**63)


def _drawn(rows: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[int, int, float]]:
    """About `wanted` keys of `rows`, each drawn with a chance in proportion to its size, with the weight it stands for."""
    step = max(1.0, total / wanted)
    chance = F.least(F.lit(1.0), F.col("size") / step)
    uniform = F.pmod(F.xxhash64("key", "id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    picked = rows.filter(uniform < chance).select("key", "id", F.greatest("size", F.lit(step)).alias("weight"))
    return sorted(map(tuple, picked.collect()))


def _quantiles(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Upper ends of ranges of near equal sampled weight."""
    if not sample:
        return []
    weights = np.cumsum([w for _, _, w in sample])
    places = np.searchsorted(weights, weights[-1] * np.arange(1, ranges) / ranges)
    return sorted({sample[p][:2] for p in places})


def _range_of(splitters: list[tuple[int, int]]):
    """The number of splitters below a (key, id)."""
    pair = np.dtype([("key", np.int64), ("id", np.int64)])
    ends = np.array(splitters, pair)

    @F.pandas_udf(T.IntegerType())
    def place(key: pd.Series, at: pd.Series) -> pd.Series:
        wanted = np.empty(len(key), pair)
        wanted["key"], wanted["id"] = key, at
        return pd.Series(np.searchsorted(ends, wanted).astype(np.int32))

    return place(F.col("key"), F.col("id"))


def shard_by_size(
    docs: DataFrame, key: Column, size: Column, shards: int, id_col: str = "doc_id", extra: dict[str, Column] | None = None
) -> DataFrame:
    """`id`, `size`, `shard`, `slot` and the `extra` columns; the shards' sizes differ by about one row's.

    Rows are ordered by (key, id). A sample of about shards x RANGES x SAMPLES keys, weighted by size, gives the splitters of
    shards x RANGES ranges; ranges that turn out to hold over twice their share are sampled again and subdivided. Only the sample
    and the totals by range, whose number depends on `shards` alone, reach the driver. Running sums inside a range and the totals of
    the ranges before it place every row exactly, so the sample decides how the work is split, never the result. Rows of one key are
    neighbours and share a shard unless a boundary falls among them; a hot key is split by id.

    A null id counts as the lowest; a null size as 0; repeated rows are placed one after another; an empty table stays empty.
    """
    wanted = F.coalesce(F.col(id_col), F.lit(LOWEST)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("row_id"), wanted.alias("id"), key.cast("long").alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    rows = written(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES
    splitters = _quantiles(_drawn(rows, total, ranges * SAMPLES, 0), ranges)
    for seed in range(1, 6):
        placed = rows.withColumn("range", _range_of(splitters)) if splitters else rows.withColumn("range", F.lit(0))
        held = {r["range"]: r["bytes"] for r in placed.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
        overfull = [r for r, n in held.items() if n > 2 * total / ranges]
        if not overfull:
            break
        heavy = sum(held[r] for r in overfull)
        parts = 2 * len(overfull) + int(2 * heavy * ranges / max(total, 1))
        more = _quantiles(_drawn(placed.filter(F.col("range").isin(overfull)), heavy, parts * SAMPLES, seed), parts)
        if set(more) <= set(splitters):
            break  # single rows larger than a range: nothing is left to divide
        splitters = sorted({*splitters, *more})
    placed = rows.withColumn("range", _range_of(splitters)) if splitters else rows.withColumn("range", F.lit(0))
    inside = Window.partitionBy("range").orderBy("key", "id")
    placed = placed.select("*", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    sizes = sorted((r["range"], r["bytes"]) for r in rows.withColumn("range", _range_of(splitters) if splitters else F.lit(0)).groupBy("range").agg(F.sum("size").alias("bytes")).collect())
    starts = np.concatenate([[0], np.cumsum([b for _, b in sizes])]).tolist()
    spark = docs.sparkSession
    offsets = spark.createDataFrame([(r, int(starts[i])) for i, (r, _) in enumerate(sizes)], "range int, start long")
    middle = F.col("start") + F.col("before") + F.col("size") / 2
    shard = F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
    placed = written(placed.join(offsets, "range").withColumn("shard", shard), "shard-places")
    counts = sorted(map(tuple, placed.groupBy("shard", "range").count().collect()))
    first, seen = [], {}
    for s, r, n in counts:
        first.append((s, r, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    firsts = spark.createDataFrame(first, "shard int, range int, first long")
    order = Window.partitionBy("shard", "range").orderBy("key", "id")
    slots = placed.withColumn("place", F.row_number().over(order)).join(firsts, ["shard", "range"])
    return slots.select(
        F.col("row_id").alias("id"), "size", "shard", (F.col("first") + F.col("place") - 1).alias("slot"), *(extra or {})
    )


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in shards of near equal bytes (UTF-8 bytes of the text plus 16); equal texts are neighbours."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 16
    rows = shard_by_size(docs, crc, size, shards, id_col, {"text_crc32": crc})
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
