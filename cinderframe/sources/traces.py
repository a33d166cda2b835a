"""Recorded-value traces: text lines to typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderframe.plans.pin import pin
from cinderframe.functions.scalars import parse_integer, resize_payload, scalar_fields

NARROW_TAGS = ("S", "R", "P", "B")


def read_trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: `file`, `split` (byte offset of the input split) and `row` in the split.

    `(split, row)` is file order. `split` also works as the chunk of an ordered scan, because the
    number of lines in an input split is bounded by its size.
    """
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def _parts(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def _key(text: Column) -> Column:
    return parse_integer(text).try_cast("long")


def _bytes(parts: Column) -> Column:
    """Payload of the announced size: entries masked to a byte, a short payload padded with zeros."""
    size = F.get(parts, F.lit(2)).try_cast("int")
    entry = lambda p: F.lpad(F.hex(F.coalesce(p.try_cast("int"), F.lit(0)).bitwiseAND(255)), 2, "0")
    given = F.slice(parts, F.lit(4), F.greatest(size, F.lit(0)))
    payload = F.unhex(F.array_join(F.transform(given, entry), ""))
    return F.when(size >= 0, resize_payload(payload, size))


def parse_records(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Narrow records as typed columns; `valid` is false for lines that carry no usable record."""
    split = pin(lines.select(*keep, "line"), p=_parts(F.col("line")))
    tag, text = F.col("p")[0], F.get(F.col("p"), F.lit(2))
    parsed = pin(split, s=F.when(tag == "S", scalar_fields(text)))
    fields = parsed.select(
        *keep,
        F.when(tag.isin(*NARROW_TAGS), tag).alias("tag"),
        _key(F.get(F.col("p"), F.lit(1))).alias("key"),
        F.when(tag == "S", text).alias("scalar_text"),
        F.col("s.whole").alias("scalar_int"),
        F.col("s.real").alias("scalar_dbl"),
        F.col("s.digits").alias("scalar_digits"),
        F.when(tag.isin("R", "P"), parse_integer(text).try_cast("long")).alias("size_value"),
        F.when(tag == "B", _bytes(F.col("p"))).alias("payload"),
    )
    usable = (
        F.col("scalar_dbl").isNotNull() | F.col("size_value").isNotNull() | F.col("payload").isNotNull()
    )
    return pin(fields, valid=F.col("tag").isNotNull() & F.col("key").isNotNull() & usable)


def parse_wide_records(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Complete wide-vector records; short or unreadable ones are dropped."""
    parsed = pin(lines.select(*keep, "line"), p=_parts(F.col("line"))).where(F.col("p")[0] == "V")
    at = lambda i: F.get(F.col("p"), F.lit(i))
    typed = parsed.select(
        *keep,
        _key(at(1)).alias("key"),
        at(2).alias("_sign"),
        _key(at(3)).try_cast("int").alias("value_bits"),
        _key(at(4)).try_cast("int").alias("_n"),
        "p",
    ).where(F.col("_sign").isin("S", "U") & (F.col("_n") >= 0) & (F.size("p") >= F.col("_n") + 5))
    values = F.transform(
        F.slice("p", F.lit(6), F.col("_n")), lambda v: parse_integer(v).try_cast("decimal(20,0)")
    )
    return (
        pin(typed, wide=values)
        .select(*keep, "key", (F.col("_sign") == "S").alias("is_signed"), "value_bits", "wide")
        .where(
            F.col("key").isNotNull()
            & F.col("value_bits").isNotNull()
            & F.forall("wide", lambda v: v.isNotNull())
        )
    )
