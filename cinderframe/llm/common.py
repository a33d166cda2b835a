"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from cinderframe.session import written

#: Characters that end a word: [\x20\x09-\x0D], also what bytes.split() takes for white space.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of text that a task's arrays cover at once; a longer document is one piece of its own.
PIECE = 1 << 19


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only `id` and `text`; a null text is the empty one. Other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_column: Column, parts: int) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo `parts`, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == 2, F.lit(False))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), offsets[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8), offsets


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows i..j of at most `most` bytes (or one row): i, j, their bytes, their offsets from 0."""
    data, offsets = buffer_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept by the worker up to the size of a piece."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held)
        if n <= 8 * PIECE:
            _POWERS[base] = held
    return held[:n]


def inverse(base: int) -> int:
    """What an odd base times is 1 modulo 2 ** 64."""
    return pow(base, -1, 1 << 64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[k]:offsets[k+1]] along the first axis; 0 for empty ranges."""
    total = np.zeros((len(offsets) - 1, *values.shape[1:]), np.result_type(values, np.float32))
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return total


def ordered_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row`, `id`, `text`: a unique `row` number in the order of ids.

    Where ids are unique and present, they are the numbers. Otherwise rows are sorted by id (null first) and text, and the sorted
    table, with numbers, is written to the shared folder.
    """
    rows = text_rows(docs, id_col, text_col)
    ids = rows.groupBy("id").count()
    if not ids.filter("id is null or count > 1").limit(1).count():
        return rows.select(F.col("id").cast("long").alias("row"), "id", "text")
    dealt = rows.withColumn("code", F.xxhash64("text")).repartitionByRange("id", "code").sortWithinPartitions("id", "code")
    return written(dealt.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "ordered-rows")


def packed(rows: DataFrame, key: str = "row") -> DataFrame:
    """`key` and the text in zstd as `body`, which moves in half the bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = [press.compress(text.encode()) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], [key, "body"])

    return rows.select(key, "text").mapInArrow(pack, f"{key} long, body binary")
