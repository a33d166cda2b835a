"""Ordered computations over groups of any size.

A window over one key runs in one task, so a key that holds a third of the table is a third of the
job. Here every ordered computation is cut into cells `(keys, chunk)`, where `chunk` is a function
of the ordering value. A cell is scanned by one task; what happened in earlier cells arrives as one
carried value per cell. Cells in turn are cut into cells of cells, so the carried values of a hot key
are no single task either; what is ordered per key is one row for each CELLS cells' worth of positions.

The caller picks `chunk` so that a cell has a bound that does not depend on how hot the key is:
`position div width` for values that are unique per key, or a pre-aggregated value's bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.session import written

CHUNK_ROWS = 1 << 18
# Bits of a chunk's number that are left out of the number of its cell of cells.
CELL_BITS = 18
# Distinct values of a percentile's cell that are put in order; larger cells are narrowed further.
ORDERED_VALUES = 1 << 12
# Bits by which a round narrows the range of values that holds a wanted rank.
RADIX_BITS = 12
_RANKS = ("_r1", "_r2", "_r3")
# Groups by hash of the keys whose rows are counted to tell hot keys apart.
KEY_GROUPS = 1 << 16
# The cell of NULLs, in front of all others.
_NO_VALUE = -(1 << 62)


def chunk_of(position: Column, width: int = CHUNK_ROWS) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also pairs NULL keys; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def split_by_size(df: DataFrame, keys: list[str], also: tuple[DataFrame, ...] = (), limit: int = CHUNK_ROWS) -> tuple[Column, Column] | None:
    """Conditions for the rows of keys that are few enough for one task, and for all others; None if there are no others.

    Rows of `df` and `also` are counted by groups of keys, not by key, so the count is a small aggregate however many keys there are. A
    group with more than `limit` rows counts as hot as a whole: what is done with hot keys is right for any other, too.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS))
    counted = reduce(DataFrame.unionAll, [d.select(group.alias("_group")) for d in (df, *also)]).groupBy("_group").count()
    hot = [row[0] for row in counted.where(F.col("count") > limit).select("_group").collect()]
    return (~group.isin(hot), group.isin(hot)) if hot else None


def _one_key(keys: list[str]) -> Column:
    """The keys as one struct: never NULL itself, equal where all its fields are equal or both NULL."""
    return F.struct(*keys) if keys else F.struct(F.lit(0))


def _dealt(df: DataFrame, cell: Column, name: str) -> DataFrame:
    """The rows of `df` with `name`, the struct `cell`, in one exchange on it.

    Rows travel as one array column that is unfolded behind the exchange. Columns are not pruned through
    that, so all that is computed from the result reads the same exchange instead of the source again.
    """
    packed = df.select(cell.alias(name), F.array(F.struct(*df.columns)).alias("_rows"))
    return packed.repartition(name).select(name, F.inline("_rows"))


def _carried(totals: DataFrame, fold) -> DataFrame:
    """`_cell`, `_carry`: what all earlier cells of the same keys come to, from `_cell` and `_part`."""
    chunk = F.col("_cell.chunk")
    wide = _dealt(totals, F.struct(F.col("_cell.key").alias("key"), F.shiftright(chunk, CELL_BITS).alias("chunk")), "_wide")
    before = (Window.unboundedPreceding, -1)
    above = wide.groupBy("_wide").agg(fold(F.col("_part")).alias("_sum"))
    above = above.select(
        "_wide", fold(F.col("_sum")).over(Window.partitionBy("_wide.key").orderBy("_wide.chunk").rowsBetween(*before)).alias("_above")
    )
    inside = fold(F.col("_part")).over(Window.partitionBy("_wide").orderBy("_cell.chunk").rowsBetween(*before))
    return wide.select("_wide", "_cell", inside.alias("_inside")).join(above, "_wide").select("_cell", "_above", "_inside")


def _scan(df: DataFrame, keys: list[str], order: list, chunk: Column, out: str, inclusive: bool, value: Column, fold, both) -> DataFrame:
    """`fold` of `value` over all rows up to each one; `both` puts two results together.

    One read of `df`, one exchange of its rows: the scan inside a cell, the cells' totals and the join that
    brings the carried values back all use the partitioning by cell. Columns that nobody needs should be
    left out of `df`, as all of them travel.
    """
    rows = _dealt(df, F.struct(_one_key(keys).alias("key"), chunk.alias("chunk")), "_cell")
    totals = rows.groupBy("_cell").agg(fold(value).alias("_part"))
    span = (Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumn("_local", fold(value).over(Window.partitionBy("_cell").orderBy(*order).rowsBetween(*span)))
    joined = local.join(_carried(totals, fold), "_cell")
    return joined.select(*[c for c in df.columns if c != out], both(both(F.col("_above"), F.col("_inside")), F.col("_local")).alias(out))


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running_sum(
    df: DataFrame, keys: list[str], order: list, chunk: Column, value: Column, out: str, inclusive=True
) -> DataFrame:
    return _scan(df, keys, order, chunk, out, inclusive, value, F.sum, _plus)


def running_max(
    df: DataFrame, keys: list[str], order: list, chunk: Column, value: Column, out: str, inclusive=True
) -> DataFrame:
    """NULL where nothing precedes."""
    return _scan(df, keys, order, chunk, out, inclusive, value, F.max, F.greatest)


def number_rows(df: DataFrame, keys: list[str], order: list, chunk: Column, out: str) -> DataFrame:
    """1-based position of each row within its keys."""
    return running_sum(df, keys, order, chunk, F.lit(1).cast("long"), out)


def _value_cell(value: Column) -> Column:
    """Monotone bucket of about one per cent relative width: at most 8,000 of them, however many values there are."""
    magnitude = F.floor(F.log2(F.abs(value).cast("double")) * 64)
    cell = F.when(value > 0, magnitude + 1).when(value < 0, -magnitude - 1).when(value == 0, 0).cast("long")
    return F.coalesce(cell, F.lit(_NO_VALUE))




def _holding(cells: DataFrame) -> DataFrame:
    """Of cells with `_before` and `_cn`, those that hold a wanted rank, and cells of keys without any sample."""
    holds = [(F.col("_before") < F.col(r)) & (F.col(r) <= F.col("_before") + F.col("_cn")) for r in _RANKS]
    return cells.where(holds[0] | holds[1] | holds[2] | (F.col("_total") == 0))


def _narrowed(counted: DataFrame, wanted: DataFrame, shift: int) -> tuple[DataFrame, DataFrame]:
    """One round of the selection: the wanted cells cut at multiples of 2 ** shift, and the values still in question.

    A cell falls apart into at most 2 ** (RADIX_BITS + 1) parts, which are counted map-side first and then
    summed up in the order of their prefixes.
    """
    # a block of the values' bits may reach into two wanted cells, so a part is named after its cell's least value, too
    prefix = F.coalesce(F.shiftright("_v", shift), F.lit(_NO_VALUE))
    near = written(
        counted.join(wanted.drop("_rows", "_hi", "_cn"), ["_key", "_cell"])
        .withColumn("_outer", F.struct("_key", "_cell"))
        .withColumn("_cell", F.struct(F.col("_lo").alias("cell"), prefix.alias("prefix")))
        .drop("_lo"),
        "values-in-question",
    )
    carried = [F.first(c).alias(c) for c in ("_before", "_total", "_sum", "_min", "_max", *_RANKS)]
    parts = near.groupBy("_key", "_outer", "_cell").agg(
        F.sum("_n").alias("_cn"), F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *carried
    )
    earlier = Window.partitionBy("_outer").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_cn").over(earlier), F.lit(0)))
    return near.select("_key", "_v", "_n", "_cell"), _holding(parts.drop("_outer"))


def exact_summary(df: DataFrame, keys: list[str], value: str, ordered: int = ORDERED_VALUES) -> DataFrame:
    """count, mean, median (mean of the middle two), nearest-rank p95, min and max per key.

    Exact without holding a key's values in one place, by radix selection: values are counted first, and
    counts by bucket say which bucket holds a wanted rank. While such a bucket has more than `ordered` distinct
    values, all wanted ones are cut by the next bits of their values and counted again; each round reads only
    the values still in question. At last a bucket of bounded size is put in order. The source is read once. Keys
    with NULLs only show no samples and NULL figures.
    """
    counted = (
        df.groupBy(_one_key(keys).alias("_key"), F.col(value).cast("long").alias("_v"))
        .agg(F.count(value).alias("_n"))
        .withColumn("_cell", _value_cell(F.col("_v")))
    )
    counted = written(counted, "value-counts")
    per_key = Window.partitionBy("_key")
    earlier = per_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        counted.groupBy("_key", "_cell")
        .agg(
            F.sum("_n").alias("_cn"),
            F.sum(F.col("_v").cast("decimal(20,0)") * F.col("_n").cast("decimal(18,0)")).alias("_cs"),
            F.count(F.lit(1)).alias("_rows"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
        )
        .select(
            "_key",
            "_cell",
            "_cn",
            "_rows",
            "_lo",
            "_hi",
            F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_cn").over(per_key).alias("_total"),
            F.sum("_cs").over(per_key).alias("_sum"),
            F.min("_lo").over(per_key).alias("_min"),
            F.max("_hi").over(per_key).alias("_max"),
        )
    )
    total = F.col("_total")
    ranks = (F.floor((total + 1) / 2), F.floor(total / 2) + 1, F.greatest(F.lit(1), F.ceil(F.lit(0.95).cast("double") * total)))
    wanted = _holding(cells.withColumns({name: rank.cast("long") for name, rank in zip(_RANKS, ranks)}))
    while True:
        wanted = written(wanted, "wanted-values")
        large = wanted.where(F.col("_rows") > ordered).agg(F.max(F.col("_hi").cast("decimal(20,0)") - F.col("_lo"))).first()[0]
        if large is None:
            break
        counted, wanted = _narrowed(counted, wanted, max(0, int(large).bit_length() - RADIX_BITS))
    running = Window.partitionBy("_key", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.join(wanted, ["_key", "_cell"])
    found = found.withColumn("_upto", F.col("_before") + F.sum("_n").over(running))
    at = {r: F.min(F.when(F.col("_upto") >= F.col(r), F.col("_v"))) for r in _RANKS}
    summary = found.groupBy("_key").agg(
        F.first("_total").alias("samples"),
        F.try_divide(F.first("_sum").cast("double"), F.first("_total")).alias("mean"),
        ((at["_r1"].cast("decimal(20,0)") + at["_r2"].cast("decimal(20,0)")).cast("double") / 2).alias("median"),
        at["_r3"].alias("p95"),
        F.first("_min").alias("min"),
        F.first("_max").alias("max"),
    )
    return summary.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *[c for c in summary.columns if c != "_key"])
