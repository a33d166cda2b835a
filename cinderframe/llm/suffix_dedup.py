"""Repeated passages by a distributed suffix sort with hash comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cinderframe.llm.common import BASE, inverse, ordered_rows, packed, pieces, powers
from cinderframe.session import written

#: Bytes of the seed by which windows meet; groups of more runs than MEET are dealt out window by window.
SEED, MEET = 32, 2000
SECOND = 0xD1342543DE82EF95
_CODES = np.random.default_rng(23).integers(1, 1 << 63, (2, 256), np.uint64)


class PrefixHashes:
    """Polynomial hashes of all prefixes of some bytes, and so of any substring, modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: int = BASE, codes: np.ndarray = _CODES[0]):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers(base, len(data)), out=self.total[1:])
        self.back = powers(inverse(base), len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """choose (minimum or maximum) of values[p : p + width] for every p."""
    held, span = values, 1
    while 2 * span <= width:
        held, span = choose(held[:-span], held[span:]), 2 * span
    rest = width - span
    return choose(held[: len(held) - rest], held[rest:]) if rest else held


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of `length` bytes that share their least seed: document, start, number, seed, content hash, again.

    Equal windows have equal seeds, so they meet in the seed's group. `again` marks runs that hold their seed more than once, the
    only ones in which a window can equal another of the same run.
    """
    n, width = len(data), length - SEED + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.astype(bool)
    hashes = PrefixHashes(data)
    at = np.arange(n - SEED + 1)
    seeds = _mix(hashes.of(at, at + SEED))
    least = _sliding(seeds, width, np.minimum)  # of the window at p
    valid = np.zeros(n + 1, np.int32)
    full = offsets[1:] - offsets[:-1] >= length
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - length + 1, -1)
    valid = np.cumsum(valid)[: len(least)] > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    starts_doc = offsets[:-1][full]
    new[starts_doc] = True
    ends_run = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    starts_run = np.flatnonzero(valid & new)
    count = ends_run - starts_run
    seed = least[starts_run]
    # places where a seed is the least of every window... of some window that holds it
    top = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(top, width, np.maximum)[: len(seeds)] == seeds)
    low, high = np.searchsorted(chosen, starts_run), np.searchsorted(chosen, ends_run + width - 1)
    held, left = np.zeros(len(seed), np.int32), np.arange(len(seed))
    while len(left):
        left = left[low[left] < high[left]]
        held[left] += seeds[chosen[low[left]]] == seed[left]
        low[left] += 1
    content = PrefixHashes(data, SECOND, _CODES[1]).of(starts_run, ends_run + length - 1)
    doc = np.searchsorted(offsets, starts_run, "right") - 1
    return doc, starts_run - offsets[doc], count, seed, content, held > 1


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Marks, among rows of equal keys, all but the first by `order`."""
    by = np.lexsort([*order[::-1], *keys[::-1]])
    later = np.ones(len(by), bool)
    for key in keys:
        later[1:] &= key[by][1:] == key[by][:-1]
    if len(later):
        later[0] = False
    found = np.zeros(len(by), bool)
    found[by] = later
    return found


def suffix_order(hashes: PrefixHashes, data: np.ndarray, places: np.ndarray, block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `places`, compared over `length` bytes, within blocks; and which equal the one before in that order.

    A merge sort of all blocks at once, bottom up and stable. Two suffixes are compared by binary search over the lengths at which their prefix
    hashes agree, then by the byte behind. Suffixes found equal are verified byte by byte; where bytes differ in spite of equal
    hashes, the suffix counts as different.
    """
    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        shared = common(a, b)
        equal = shared == length
        shared = np.minimum(shared, length - 1)
        return np.where(equal, or_equal, data[a + shared] < data[b + shared])

    order = np.arange(len(places))
    first = np.searchsorted(block, block)  # block numbers ascend
    size = np.searchsorted(block, block, "right") - first
    within = np.arange(len(places)) - first
    span = 1
    while len(size) and span < size.max():
        in_left = (within // span) % 2 == 0
        pair = within // (2 * span) * (2 * span)
        other = first + np.where(in_left, pair + span, pair)
        other_end = np.minimum(other + span, first + size)
        low, high = other.copy(), np.maximum(other_end, other)
        places_now = places[order]
        for left in (True, False):
            active = np.flatnonzero(in_left == left)
            while len(active):
                active = active[low[active] < high[active]]
                if not len(active):
                    break
                middle = (low[active] + high[active]) // 2
                # a left element goes in front of equal right ones
                before = less(places_now[middle], places_now[active], or_equal=not left)
                low[active] = np.where(before, middle + 1, low[active])
                high[active] = np.where(before, high[active], middle)
        own = within - pair - np.where(in_left, 0, span)
        target = first + pair + own + (low - other)
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        span *= 2
    sorted_places = places[order]
    equal = np.zeros(len(places), bool)
    if len(places) > 1:
        a, b = sorted_places[:-1], sorted_places[1:]
        alike = np.flatnonzero((block[1:] == block[:-1]) & (hashes.of(a, a + length) == hashes.of(b, b + length)))
        for part in np.array_split(alike, max(1, len(alike) // 10_000)):
            columns = np.arange(length)
            equal[part + 1] = (data[a[part][:, None] + columns] == data[b[part][:, None] + columns]).all(1)
    return order, equal


def _as_runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as runs of consecutive starts."""
    by = np.lexsort([start, row])
    row, start = row[by], start[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    return row[begin], start[begin], np.diff(np.append(begin, len(row)))


def _later_windows(seed: np.ndarray, row: np.ndarray, start: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups of runs: the windows that equal an earlier one."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    counts = sizes - length + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    run = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = begin[run] + nth
    head = np.zeros(len(places), np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | data[places + k]
    by = np.lexsort([start[run] + nth, row[run], head, seed[run]])
    differs = np.ones(len(by), bool)
    differs[1:] = (seed[run[by]][1:] != seed[run[by]][:-1]) | (head[by][1:] != head[by][:-1])
    block = np.cumsum(differs) - 1
    shared = np.bincount(block)[block] > 1
    by, block = by[shared], block[shared]
    if not len(by):
        return row[:0], start[:0], start[:0]
    order, equal = suffix_order(PrefixHashes(data), data, places[by], block, length)
    later = by[order][equal]
    return _as_runs(row[run[later]], start[run[later]] + nth[later])


def repeated_windows(rows: DataFrame, length: int = 100, meet: int = MEET) -> DataFrame:
    """row, start, count: runs of windows of `length` bytes that start earlier as well, in another row or the same.

    1. Every row's windows are cut into runs by their least seed, a hash of SEED bytes; two equal windows are in runs of one seed. Runs of equal
       content need no comparison: all but the first repeat it. Each task does so for its own rows, then all meet by seed.
    2. The first run of each content whose seed has other contents, too, fetches its bytes, and a suffix sort within the group finds
       equal windows. Groups of over `meet` runs would make long tasks; their windows are dealt out one by one by two
       64-bit hashes, and the earliest of each is found by a map-side combined minimum.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for i, _, data, offsets in pieces(batch.column(1)):
                doc, start, count, seed, content, again = window_runs(data, offsets, length)
                parts.append((ids[i + doc], start, count, seed, content, again))
            if not parts:
                continue
            row, start, count, seed, content, again = map(np.concatenate, zip(*parts))
            later = _first_of([seed, content, count], [row, start])
            for i in range(0, len(row), 200_000):
                j = slice(i, i + 200_000)
                columns = (seed[j].view(np.int64), content[j].view(np.int64), row[j], start[j], count[j], again[j] * 2 + later[j])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    names = ["seed", "content", "row", "start", "count", "marks"]
    runs = rows.select("row", "text").mapInArrow(cut, ", ".join(f"{n} long" for n in names))
    later, again = F.col("marks").bitwiseAND(1) == 1, F.col("marks").bitwiseAND(2) == 2
    # what repeats a run of its own task is settled and need not meet the others, however many they are
    runs = runs.withColumn("meet", F.when(later, F.xxhash64("row", "start")).otherwise(F.col("seed"))).repartition("meet")
    same = Window.partitionBy("meet", "content", "count", "marks").orderBy("row", "start")
    lead = (F.row_number().over(same) == 1) & ~later
    runs = runs.withColumn("lead", lead).withColumn("leads", F.sum(F.col("lead").cast("int")).over(Window.partitionBy("meet")))
    runs = runs.withColumn("open", F.col("lead") & ((F.col("leads") > 1) | again)).filter("open or not lead")
    runs = runs.select("seed", "row", "start", "count", "open", (F.col("leads") > meet).alias("many"))
    runs = written(runs, "suffix-runs")
    done = runs.filter(~F.col("open")).select("row", "start", "count")
    wanted = runs.filter("open").groupBy("row").agg(F.collect_list(F.struct("seed", "start", "count", "many")).alias("wanted"))

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for row, body, want in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, want = press.decompress(body.as_py()), want.as_py()
                found = {"seed": [], "row": [], "start": [], "body": [], "other": []}
                for w in want:
                    if w["many"]:
                        data = np.frombuffer(text[w["start"] : w["start"] + w["count"] + length - 1], np.uint8)
                        at = np.arange(w["count"])
                        one = PrefixHashes(data).of(at, at + length).view(np.int64).tolist()
                        two = PrefixHashes(data, SECOND, _CODES[1]).of(at, at + length).view(np.int64).tolist()
                        found["seed"] += one
                        found["other"] += two
                        found["start"] += range(w["start"], w["start"] + w["count"])
                        found["body"] += [None] * w["count"]
                    else:
                        found["seed"].append(w["seed"])
                        found["other"].append(None)
                        found["start"].append(w["start"])
                        found["body"].append(text[w["start"] : w["start"] + w["count"] + length - 1])
                found["row"] = [row] * len(found["start"])
                kinds = {"seed": pa.int64(), "row": pa.int64(), "start": pa.int64(), "body": pa.binary(), "other": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(found[k], kinds[k]) for k in kinds], list(kinds))

    bodies = packed(rows).join(wanted, "row").select("row", "body", "wanted")
    bodies = written(bodies.mapInArrow(fetch, "seed long, row long, start long, body binary, other long"), "suffix-bodies")
    single = bodies.filter("body is null")
    firsts = single.groupBy("seed", "other").agg(F.min(F.struct("row", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    single = single.join(firsts, ["seed", "other"]).filter("struct(row, start) <> first").select("row", "start", F.lit(1).alias("count"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            seed, row, start = (table.column(k).to_numpy() for k in ("seed", "row", "start"))
            later = _later_windows(seed, row, start, table.column("body").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in later], ["row", "start", "count"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by seed: cut where a group ends
            if batch.num_rows == 0:
                continue
            seeds = batch.column(0).to_numpy()
            if size > 6_000 and (ends := np.flatnonzero(seeds[1:] != seeds[:-1])).size:
                cut_at = int(ends[-1]) + 1
                yield found([*held, batch.slice(0, cut_at)])
                held, size = [batch.slice(cut_at)], batch.num_rows - cut_at
            else:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield found(held)

    grouped = bodies.filter("body is not null").select("seed", "row", "start", "body").repartition("seed").sortWithinPartitions("seed")
    compared = grouped.mapInArrow(compare, "row long, start long, count long")
    return done.unionByName(single).unionByName(compared)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, meet: int = MEET, with_text: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, null without `with_text`) of every row.

    Every byte that a repeated window covers goes; windows are judged on the input, in the order of ids. Null and empty texts and texts shorter
    than a window lose nothing. Rows with a null id come first; rows that repeat an id follow each other in the order of
    a hash of their texts. An empty table gives an empty result.
    """
    rows = ordered_rows(docs, id_col, text_col)
    spans = repeated_windows(rows, length, meet).groupBy("row").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    joined = packed(rows).join(spans, "row", "left").select("row", "body", "spans")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            spans_of = batch.column(2)
            at = spans_of.offsets.to_numpy()
            starts_of, counts_of = (spans_of.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, (row, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text = press.decompress(body.as_py())
                n, removed, count, kept = len(text), 0, 0, text
                if at[i + 1] > at[i]:
                    depth = np.zeros(n + 1, np.int32)
                    starts, counts = starts_of[at[i] : at[i + 1]], counts_of[at[i] : at[i + 1]]
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, starts + counts - 1 + length, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed = int(gone.sum())
                    count = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((row, n, removed, count, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                if len(out) == 500:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    result = joined.mapInArrow(remove, "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if "ordered-rows" in "".join(rows.inputFiles()[:1]):
        return result.join(rows.select("row", "id"), "row").drop("row")
    return result.withColumnRenamed("row", "id")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))
