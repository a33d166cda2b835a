"""Importance resampling towards a target corpus, on hashed runs of words."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cinderframe.llm.common import pieces, text_rows
from cinderframe.session import written

#: Bytes that a position table covers; longer spans are folded block by block.
BLOCK = 32
#: Features whose bytes are gathered at once.
GATHERED = 1 << 17
#: The polynomial of CRC-32, reflected.
POLYNOMIAL = 0xEDB88320

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def _byte_table() -> np.ndarray:
    """The remainder that each value of a byte leaves."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = (rest >> np.uint32(1)) ^ np.where(rest & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return rest


@lru_cache(maxsize=1)
def position_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By distance from the end and byte: what the byte adds; what each byte of a checksum becomes BLOCK bytes on; constants by length.

    CRC-32 without its initial and final value is linear, so the checksum of a span is the exclusive or of one entry for each byte. The
    initial value runs through as many zero bytes as the span has: the constant of its length, with the final value in it.
    """
    step = _byte_table()
    table = np.empty((BLOCK, 256), np.uint32)
    table[0] = step
    for distance in range(1, BLOCK):
        before = table[distance - 1]
        table[distance] = step[before & np.uint32(255)] ^ (before >> np.uint32(8))
    # a state s before BLOCK zero bytes: its byte k acts like a message byte at distance BLOCK - 1 - k
    onward = np.stack([table[BLOCK - 1 - k] for k in range(4)])
    constants = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)
    return table, onward, constants


def _onward(state: np.ndarray) -> np.ndarray:
    """States BLOCK bytes later."""
    onward = position_tables()[1]
    return np.bitwise_xor.reduce([onward[k][(state >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)])


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[starts[k]:ends[k]]; spans may overlap, and an empty one has 0.

    The last BLOCK bytes of a span are gathered from the position table and folded by `bitwise_xor.reduceat`. Of longer spans the
    blocks in front are folded first to last, a block of all of them at a time, each moving the state BLOCK bytes on.
    """
    table, _, constants = position_tables()
    lengths = ends - starts
    found = np.zeros(len(starts), np.uint32)
    for at in range(0, len(starts), GATHERED):
        part = slice(at, at + GATHERED)
        blocks = np.maximum(lengths[part] - 1, 0) // BLOCK
        head = lengths[part] - blocks * BLOCK  # 1..BLOCK bytes in front, then whole blocks
        state = _folded(data, starts[part], head, table) ^ constants[head]
        done = starts[part] + head
        live = np.flatnonzero(blocks)
        while len(live):
            inner = state[live] ^ np.uint32(0xFFFFFFFF)
            added = _folded(data, done[live], np.full(len(live), BLOCK), table)
            state[live] = _onward(inner) ^ added ^ np.uint32(0xFFFFFFFF)
            done[live] += BLOCK
            blocks[live] -= 1
            live = live[blocks[live] > 0]
        found[part] = state
    return found


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The exclusive or of the entries of each span's bytes; 0 for an empty span."""
    found = np.zeros(len(starts), np.uint32)
    full = np.flatnonzero(lengths)
    if not len(full):
        return found
    lengths = lengths[full]
    ends = np.cumsum(lengths)
    first = ends - lengths
    place = np.arange(ends[-1])
    distance = np.repeat(ends - 1, lengths) - place
    byte = data[place + np.repeat(starts[full] - first, lengths)]
    found[full] = np.bitwise_xor.reduceat(table.ravel()[distance << 8 | byte], first)
    return found


def word_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words of a piece with one space behind each: bytes, start and end of every word, first word of each document.

    Words are runs of other characters than [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], after A-Z became a-z; every byte of a longer code point
    belongs to a word.
    """
    inside = _WORD_BYTE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts = np.flatnonzero((edge[:-1] == 1) | (inside & cut[:-1]))
    ends = np.flatnonzero((edge[1:] == -1) | (inside & cut[1:])) + 1
    lengths = ends - starts
    out_ends = np.cumsum(lengths + 1) - 1
    out_starts = out_ends - lengths
    stream = np.full(int(out_ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    if len(ends):
        words = np.ones(len(stream), bool)
        words[out_ends] = False
        stream[words] = _LOWER[data[inside]]
    return stream, out_starts, out_ends, np.searchsorted(starts, offsets)


def buckets_of(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1..longest words of a piece's documents, by document, and where each document's begin and end."""
    stream, starts, ends, first = word_stream(data, offsets)
    last = np.repeat(first[1:], np.diff(first))  # behind the last word of a word's document
    places, owners = [], []
    for width in range(1, longest + 1):
        begin = np.flatnonzero(np.arange(len(starts)) + width <= last)
        places.append(crc32_spans(stream, starts[begin], ends[begin + width - 1]) % np.uint32(buckets))
        owners.append(np.searchsorted(first, begin, "right") - 1)
    found, owner = np.concatenate(places), np.concatenate(owners)
    if longest > 1:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, np.searchsorted(owner, np.arange(len(offsets)))


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of the whole `text` column by bucket. A task sends its own counts only, `buckets` rows at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                total += np.bincount(buckets_of(data, offsets, longest, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln(((t+1)(S+buckets)) / ((s+1)(T+buckets)))) of every bucket, from all texts of both tables."""
    counts = []
    for table in (docs, target):
        held = np.zeros(buckets, np.int64)
        for row in bucket_counts(table, longest, buckets).toLocalIterator():  # `buckets` rows at most
            held[row["bucket"]] = row["n"]
        counts.append(held)
    s, t = counts
    here, there = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((int(b) + 1) * here / ((int(a) + 1) * there))) for a, b in zip(s, t)], np.int64)


def weighed(rows: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """id, words, n_features and weight, the floored mean gain of a document's features (0 without any)."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                found, bounds = buckets_of(data, offsets, longest, len(shared.value))
                n = np.diff(bounds)
                total = np.concatenate([[0], np.cumsum(shared.value[found])])
                gain = total[bounds[1:]] - total[bounds[:-1]]
                words = np.diff(word_stream(data, offsets)[3]) if longest > 1 else n
                weight = np.where(n > 0, gain // np.maximum(n, 1), 0)
                numbers = [pa.array(x, pa.int64()) for x in (words, n, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *numbers], ["id", "words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(weigh, f"id {kind}, words long, n_features long, weight long")


def ranked(rows: DataFrame, count: int) -> DataFrame:
    """The `count` rows of highest `score`, ties to the smaller id, with their `rank` from 1; the others with a null one.

    Scores are whole numbers, so how many rows each has is a small table, whose running sum tells the score at which the draw
    ends. Only rows at that score or above are put in order, in ranges over all tasks; ranges number their own rows, and one row for each
    range tells how many stand before. Rows that agree in score and id are told apart by their other columns, null ids come last.
    """
    unranked = F.lit(None).cast("long").alias("rank")
    if count <= 0:
        return rows.select("*", unranked)
    by_score = rows.filter("drawable").groupBy("score").count()
    upto = by_score.withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("score"))))
    least = upto.agg(F.coalesce(F.max(F.when(F.col("upto") >= count, F.col("score"))), F.min("score"))).first()[0]
    near = rows.filter("drawable").filter(F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("id"), *[F.col(c) for c in rows.columns if c not in ("score", "id", "drawable")]]
    place = F.monotonically_increasing_id()
    sorted_ = written(near.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "resample-order")
    sorted_ = sorted_.withColumn("range", F.shiftright("place", 33)).withColumn("nth", F.col("place") - F.shiftleft("range", 33))
    held = sorted_.groupBy("range").count()
    before = F.sum("count").over(Window.orderBy("range")) - F.col("count")  # a row for each range
    numbered = sorted_.join(F.broadcast(held.select("range", before.alias("before"))), "range")
    rank = F.col("before") + F.col("nth") + 1
    numbered = numbered.select(*rows.columns, F.when(rank <= count, rank).alias("rank"))
    rest = rows.filter(~F.col("drawable") | (F.col("score") < least)).select("*", unranked)
    return numbered.unionByName(rest)


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = 1, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10,
) -> DataFrame:
    """id, n_features, weight, score and rank of every document; `rank` is null for those not drawn.

    Features are runs of 1..longest words, hashed into buckets. A bucket's gain compares its frequency in all documents and in
    all target texts; a document's weight is the mean gain. Documents of `least_words` words or more are drawn without replacement, `percent` in
    100 of them, by the highest weight plus Gumbel noise from the sha256 of `seed`:id.

    Two passes over the text and no shuffle of it; what tasks send are `buckets` counts each, then four numbers a row. A null text
    is empty and has weight 0; a null id is hashed as the empty string; rows that repeat an id share their noise and are drawn row by row.
    Empty tables work: without target texts all gains compare with nothing; without documents the result is empty.
    """
    rows = text_rows(docs, id_col, text_col)
    gains = bucket_gains(rows, target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text")), longest, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")
    scored = weighed(rows, gains, longest).select(
        "id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("words") >= least_words).alias("drawable")
    )
    scored = written(scored, "resample-scores")
    wanted = scored.filter("drawable").count() * percent // 100
    return ranked(scored, wanted).drop("drawable")
