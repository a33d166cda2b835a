"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cinderframe.llm.common import pieces, sums, text_rows
from cinderframe.session import bounded_batches

#: At most about so many labelled documents, and so much of their text, train the field.
TRAIN_DOCS, TRAIN_BYTES = 2000, 8 << 20
#: A longer text is scored but teaches nothing.
LONGEST = 1 << 20
STEPS, RATE, PENALTY = 300, 0.1, 1e-4
GROUPS = ("upper", "lower", "digit", "space", "stop", "mark", "bar", "symbol", "other")


def _byte_groups() -> np.ndarray:
    group = np.full(256, GROUPS.index("other"), np.uint8)
    for name, members in {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c",
        "stop": b".,;:'\"?()-", "mark": b"!", "bar": b"|\\/_~^=<>[]{}", "symbol": b"#$%&*+@`",
    }.items():
        group[list(members)] = GROUPS.index(name)
    return group


GROUP_OF = _byte_groups()
N_OWN = len(GROUPS) + 9
N_FEATURES = 3 * N_OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of some documents, the first line of each document (and the end), the lines' lengths in bytes.

    A document has one line more than line breaks, an empty one included. A line's features are its own shares of byte
    groups, its word lengths and repetition, and those of the line before and behind it (zeros beyond the ends).
    """
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # an empty document shares its offset with the next one, so lines are counted, not looked up by place
    per_doc = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(per_doc)])
    bounds = np.append(starts, n)
    ends = np.append(starts[1:], n)
    last_of_doc = np.zeros(len(starts), bool)
    last_of_doc[first[1:] - 1] = True
    length = ends - starts - np.where(last_of_doc, 0, 1)
    kinds = GROUP_OF[data]
    size = np.maximum(length, 1).astype(np.float32)
    own = np.zeros((len(starts), N_OWN), np.float32)
    for k in range(len(GROUPS)):
        own[:, k] = sums((kinds == k).astype(np.float32), bounds) / size
    line_break = np.where(last_of_doc, 0, 1)
    own[:, GROUPS.index("other")] -= line_break / size
    words = own[:, GROUPS.index("space")] * size + 1
    at = len(GROUPS)
    own[:, at] = np.log1p(length) / 8
    own[:, at + 1] = np.minimum(length / words / 20, 1)
    repeat = np.zeros(n, np.float32)
    repeat[1:] = (data[1:] == data[:-1]) & (data[1:] != 32)
    own[:, at + 2] = sums(repeat, bounds) / size
    symbol_end = np.zeros(n, np.float32)
    symbol_end[:-1] = (kinds[:-1] >= GROUPS.index("mark")) & (kinds[:-1] <= GROUPS.index("symbol")) & (kinds[1:] == GROUPS.index("space"))
    own[:, at + 3] = sums(symbol_end, bounds) / np.maximum(words, 1)
    own[:, at + 4] = length == 0
    # a line whose bytes were seen before in its document, and a line of few different words
    mixed = data.astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(int(length.max(initial=0)) + 2, 0x5851F42D4C957F2D, np.uint64))
    place = np.arange(n) - np.repeat(starts, ends - starts)
    codes = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(ends > starts)
    values = mixed * powers[place]
    codes[full] = np.add.reduceat(values, starts[full]) if len(full) else 0
    breaks_in = np.flatnonzero(~last_of_doc)
    codes[breaks_in] -= values[ends[breaks_in] - 1]
    doc_of = np.repeat(np.arange(len(offsets) - 1), per_doc)
    pair = np.empty(len(starts), np.dtype([("doc", np.int64), ("code", np.uint64)]))
    pair["doc"], pair["code"] = doc_of, codes
    order = np.lexsort((codes, doc_of))
    same = np.zeros(len(starts), bool)
    same[order[1:]] = pair[order[1:]] == pair[order[:-1]]
    own[:, at + 5] = same & (length > 0)
    inside = (kinds != GROUPS.index("space")) & (data != 10)
    word_starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]) | inside & np.isin(np.arange(n), offsets[:-1]))
    if len(word_starts):
        held = np.where(inside, values, 0).astype(np.uint64)
        # position-free code: divide by the power at the word's start
        inverse = np.cumprod(np.full(len(powers), pow(0x5851F42D4C957F2D, -1, 1 << 64), np.uint64))
        word_codes = np.add.reduceat(held, word_starts) * inverse[place[word_starts]]
        line_of = np.searchsorted(starts, word_starts, "right") - 1
        order = np.lexsort((word_codes, line_of))
        again = (line_of[order[1:]] == line_of[order[:-1]]) & (word_codes[order[1:]] == word_codes[order[:-1]])
        n_words = np.bincount(line_of, minlength=len(starts))
        n_again = np.bincount(line_of[order[1:]][again], minlength=len(starts))
        own[:, at + 6] = n_again / np.maximum(n_words, 1)
        own[:, at + 7] = np.minimum(n_words, 60) / 60
    own[:, at + 8] = own[:, GROUPS.index("upper")] > 0.5
    before = np.vstack([np.zeros((1, N_OWN), np.float32), own[:-1]])
    before[first[:-1]] = 0
    behind = np.vstack([own[1:], np.zeros((1, N_OWN), np.float32)])
    behind[first[1:] - 1] = 0
    return np.hstack([own, before, behind, np.ones((len(own), 1), np.float32)]), first, length


@dataclass
class LineField:
    """Weights of a two-label chain: `emit` for the label good against bad, `move[a, b]` for label b behind label a."""

    emit: np.ndarray
    move: np.ndarray


def marginals(field: LineField, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, the summed pair marginals of all chains, the log partition of every chain.

    Forward and backward passes go over all documents of a piece at once, longest first, one line position at a time.
    """
    score = np.zeros((len(features), 2))
    score[:, 1] = features @ field.emit
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begins, ordered = first[:-1][order], count[order]
    longest = int(ordered[0]) if len(ordered) else 0
    alive = np.searchsorted(-ordered, -np.arange(longest), "left")  # chains longer than t
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    move = field.move
    for t in range(longest):
        at = begins[: alive[t]] + t
        forward[at] = score[at]
        if t:
            last = forward[at - 1]
            forward[at] += np.logaddexp(last[:, :1] + move[0], last[:, 1:] + move[1])
    for t in range(longest - 2, -1, -1):
        at = begins[: alive[t + 1]] + t
        onward = backward[at + 1] + score[at + 1]
        backward[at] = np.logaddexp(onward[:, :1] + move[:, 0], onward[:, 1:] + move[:, 1])
    log_z = np.logaddexp(forward[first[1:] - 1, 0], forward[first[1:] - 1, 1])
    z_line = np.repeat(log_z, count)
    good = np.exp(forward[:, 1] + backward[:, 1] - z_line)
    has_next = np.ones(len(features), bool)
    has_next[first[1:] - 1] = False
    at = np.flatnonzero(has_next)
    pairs = forward[at][:, :, None] + move + (score[at + 1] + backward[at + 1])[:, None, :] - z_line[at][:, None, None]
    return good, np.exp(pairs).sum(0), log_z


def train(texts: list[str], labels: list[int]) -> LineField:
    """Full-batch gradient ascent on the conditional likelihood of the lines' labels, which are those of their document."""
    field = LineField(np.zeros(N_FEATURES), np.zeros((2, 2)))
    if not len(texts):
        return field
    parts = [line_features(data, offsets)[:2] for _, _, data, offsets in pieces(pa.array(texts, pa.large_string()))]
    features = np.vstack([f for f, _ in parts])
    count = np.concatenate([np.diff(first) for _, first in parts])
    first = np.concatenate([[0], np.cumsum(count)])
    target = np.repeat(np.array(labels, float), count)
    # every document weighs the same, and both labels together
    share = np.bincount(np.array(labels, int), minlength=2).clip(1) / len(labels)
    weight_doc = 0.5 / share[np.array(labels, int)] / count
    weight = np.repeat(weight_doc, count)
    told = np.zeros((2, 2))
    for label in (0, 1):
        told[label, label] = ((count - 1) * (np.array(labels) == label)).sum()
    steps = [np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        good, pairs, _ = marginals(field, features, first)
        slope = (features * (weight * (target - good))[:, None]).sum(0) / len(labels) - PENALTY * field.emit
        slope_move = (told - pairs) / len(features) - 0.05 * field.move
        for name, g, m, v in (("emit", slope, 0, 1), ("move", slope_move, 2, 3)):
            steps[m] = 0.9 * steps[m] + 0.1 * g
            steps[v] = 0.99 * steps[v] + 0.01 * g * g
            change = steps[m] / (1 - 0.9**step) / (np.sqrt(steps[v] / (1 - 0.99**step)) + 1e-8)
            setattr(field, name, getattr(field, name) + RATE * change)
    return field


def scores(field: LineField, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; an empty line weighs as one byte."""
    features, first, length = line_features(data, offsets)
    good, _, _ = marginals(field, features, first)
    weight = np.maximum(length, 1).astype(float)
    return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """Train on a bounded sample of the labelled documents for which `learn` (over the column id) holds.

    The sample is the TRAIN_DOCS documents of the smallest hash of the id, without texts over LONGEST bytes, and of these as many as
    TRAIN_BYTES allow; each label has half of TRAIN_BYTES to itself. Rows without id or label teach nothing; of several labels of one
    id the larger counts, of several texts the first in order. A label whose texts are all too long is an error, one that no document
    has a warning.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).filter(learn)
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    joined = text_rows(docs, id_col, text_col).join(F.broadcast(chosen), "id")  # TRAIN_DOCS rows of an id and a label
    short = F.when(F.octet_length("text") <= LONGEST, F.col("text"))
    each = joined.groupBy("id", "label").agg(F.min(short).alias("text"))  # no text where all of an id are too long
    size = F.coalesce(F.octet_length("text") + 1, F.lit(0))
    by_hash = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    total, own = F.sum(size).over(by_hash), F.sum(size).over(by_hash.partitionBy("label"))
    sample = each.select("id", "text", "label", total.alias("total"), own.alias("own"))
    sample = sample.filter((F.col("total") <= TRAIN_BYTES) | (F.col("own") <= TRAIN_BYTES // 2)).collect()
    long = {int(r["label"]) for r in sample if r["text"] is None}
    sample = sorted((r for r in sample if r["text"] is not None), key=lambda r: (r["id"], r["text"]))
    found = {int(r["label"]) for r in sample}
    if long - found:
        raise ValueError(f"every sampled document labelled {sorted(long - found)} has more than {LONGEST} bytes")
    if len(found) < 2:
        warnings.warn(f"quality is learned from documents labelled {sorted(found)} only")
    return train([r["text"] for r in sample], [int(r["label"]) for r in sample])


def keep_good(docs: DataFrame, field: LineField, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `least`; a filter without a shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = batch.column(at).fill_null("")
                found = [scores(shared.value, data, offsets) for _, _, data, offsets in pieces(text)]
                yield batch.filter(pa.array(np.concatenate(found) >= least))

    return docs.mapInArrow(keep, docs.schema)


def quality_scores(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document, in one pass without a shuffle.

    A null or empty text is one empty line and is scored like any other. Ids, null or repeated, are carried through. Very long
    texts are pieces of their own; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = text_rows(docs, id_col, text_col)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [scores(shared.value, data, offsets) for _, _, data, offsets in pieces(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["id", "score"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
