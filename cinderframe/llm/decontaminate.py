"""Benchmark passages in training text: BM25 over an inverted index of test items with block maxima, then verified overlap."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cinderframe.llm.common import BASE, inverse, pieces, powers, sums

#: Words of a shingle and the share of an item's shingles that a passage has to hold.
SHINGLE, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
#: Items of one broadcast index, and blocks of items of similar length in it.
SHARD_ITEMS, BLOCKS = 2048, 32
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD_BYTE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_RANDOM = np.random.default_rng(7)
CODE_OF = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
#: A term is essential when at most this share of a shard's items has it.
ESSENTIAL = 0.03


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and non-ASCII characters, in lower case."""
    return WORD.findall(text.lower())


def shingles_of(words: list[str]) -> set[tuple[str, ...]]:
    """Distinct runs of SHINGLE words; the whole, where there are fewer."""
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit code of every word; words end with their document."""
    inside = WORD_BYTE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODE_OF[data] * powers(BASE, len(data)), out=total[1:])
    return starts, ends, (total[ends] - total[starts]) * powers(inverse(BASE), len(data) + 1)[starts]


@dataclass
class ItemIndex:
    """One shard of test items: postings as a weight matrix by term and item, block maxima over it, thresholds.

    `least[i]` is a score that every passage holding OVERLAP of item i's shingles reaches: the sum of the item's term weights less
    its m heaviest, where m shingles may be missing and so at most m terms. `rare_least[i]` is the same over the essential terms alone,
    those of few items; as in MaxScore, the other lists need not be opened to rule a passage out. Essential terms come first.
    """

    ids: list
    question: list[set]
    answer: list[set]
    rare_codes: np.ndarray
    rare_weight: np.ndarray
    best: np.ndarray
    block_of: np.ndarray
    rare_least: np.ndarray
    block_least: np.ndarray
    weights: list[dict[str, float]]
    least: np.ndarray
    stride: int


def build_index(ids: list, questions: list[str], answers: list[str]) -> ItemIndex | None:
    """BM25 weights of the items' terms; items without words are left out, as nothing can hold them."""
    kept = []
    for i, q, a in zip(ids, questions, answers):
        words = words_of(f"{q}\n{a}")
        if words:
            kept.append((len(words), i, q, a, words))
    if not kept:
        return None
    kept.sort(key=lambda x: (x[0], str(x[1])))
    lengths = np.array([x[0] for x in kept], float)
    terms: dict[str, int] = {}
    tf = [Counter(x[4]) for x in kept]
    for counts in tf:
        for word in counts:
            terms.setdefault(word, len(terms))
    df = Counter(word for counts in tf for word in counts)
    n = len(kept)
    weight = np.zeros((len(terms), n), np.float32)
    rare = np.array([df[word] <= max(2, ESSENTIAL * n) for word in terms])
    least, rare_least = np.zeros(n), np.zeros(n, np.float32)
    question, answer, weights = [], [], []
    for i, (length, _, q, _, words) in enumerate(kept):
        own = {}
        for word, count in tf[i].items():
            idf = np.log(1 + (n - df[word] + 0.5) / (df[word] + 0.5))
            own[word] = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / lengths.mean()))
            weight[terms[word], i] = own[word]
        distinct = len(shingles_of(words))
        missing = distinct - int(np.ceil(OVERLAP * distinct - 1e-9))
        whole, part = (np.sort(list(v)) for v in (own.values(), [v for w, v in own.items() if rare[terms[w]]]))
        least[i] = whole[: max(len(whole) - missing, 0)].sum() * (1 - 1e-4)
        rare_least[i] = part[: max(len(part) - missing, 0)].sum() * (1 - 1e-4)
        weights.append(own)
        question.append(shingles_of(words_of(q)))
        answer.append(shingles_of(words) - question[-1])
    blocks = min(BLOCKS, n)
    block_of = np.arange(n) * blocks // n
    cuts = np.searchsorted(block_of, np.arange(blocks))
    data = np.frombuffer(b" ".join(w.encode() for w in terms), np.uint8)
    codes = word_codes(data, np.array([0, len(data)]))[2]
    order = np.argsort(codes)
    order = order[rare[order]]
    weight = weight[order]
    best = np.maximum.reduceat(weight, cuts, axis=1) if len(order) else np.zeros((0, blocks), np.float32)
    return ItemIndex(
        [x[1] for x in kept], question, answer, codes[order], weight, best, block_of, rare_least, np.minimum.reduceat(rare_least, cuts),
        weights, least, int(1.5 * lengths.max()) + 1,
    )


def found_in(index: ItemIndex, data: np.ndarray, offsets: np.ndarray) -> dict[int, dict]:
    """For each document of a piece: the items that a passage of it holds, with their question and answer overlap.

    Passages are two strides long and start every stride, so text of up to 1.5 times the longest item is whole in one of them. A block's
    maxima bound the score of its items; only blocks whose bound reaches their least threshold are scored item by item, only items at
    their own threshold get a full BM25 score, and those still above are compared shingle by shingle, on the words themselves.
    """
    starts, ends, codes = word_codes(data, offsets)
    if not len(codes):
        return {}
    place = np.searchsorted(index.rare_codes, codes)
    place[place == len(index.rare_codes)] = 0
    known = index.rare_codes[place] == codes if len(index.rare_codes) else np.zeros(len(codes), bool)
    first = np.searchsorted(starts, offsets)  # first word of each document
    count = np.diff(first)
    segments = np.maximum(-(-count // index.stride), 0)
    doc_of = np.repeat(np.arange(len(count)), segments)
    nth = np.arange(len(doc_of)) - np.repeat(np.concatenate([[0], np.cumsum(segments)[:-1]]), segments)
    begin = first[doc_of] + nth * index.stride
    end = np.minimum(begin + index.stride, first[doc_of + 1])
    hits = np.flatnonzero(known)
    bounds = np.searchsorted(hits, np.append(begin, len(codes)))
    half = sums(index.best[place[hits]], bounds)
    whole = half.copy()
    with_next = np.flatnonzero(doc_of[1:] == doc_of[:-1])
    whole[with_next] += half[with_next + 1]
    end[with_next] = end[with_next + 1]
    passages, blocks = np.nonzero(whole >= index.block_least)
    found: dict[int, dict] = {}
    if not len(passages):
        return found
    cuts = np.flatnonzero(np.diff(passages, prepend=-1))
    for passage, blocks_of in zip(passages[cuts], np.split(blocks, cuts[1:])):
        items = np.flatnonzero(np.isin(index.block_of, blocks_of))
        span = slice(begin[passage], end[passage])
        score = index.rare_weight[np.ix_(place[span][known[span]], items)].sum(0)
        items = items[score >= index.rare_least[items]]
        if not len(items):
            continue
        words = words_of(data[starts[begin[passage]] : ends[end[passage] - 1]].tobytes().decode("utf-8", "replace"))
        counts, present = Counter(words), None
        for item in items:
            if sum(weight * counts[word] for word, weight in index.weights[item].items()) < index.least[item]:
                continue
            present = present or shingles_of(words)
            q, a = index.question[item], index.answer[item]
            in_q, in_a = len(q & present), len(a & present)
            if in_q + in_a >= OVERLAP * (len(q) + len(a)):
                row = (round(in_q / max(len(q), 1), 6), round(in_a / max(len(a), 1), 6) if a else None)
                doc = found.setdefault(int(doc_of[passage]), {})
                doc[index.ids[item]] = max(row, doc.get(index.ids[item], row), key=lambda r: (r[0] or 0) + (r[1] or 0))
    return found


def item_shards(items: DataFrame, id_col: str, question_col: str, answer_col: str | None) -> Iterator[ItemIndex]:
    """Indexes of SHARD_ITEMS items each, in order of length and id; one is on the driver at a time."""
    question = F.coalesce(F.col(question_col), F.lit(""))
    answer = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit("")
    rows = items.select(F.col(id_col).alias("id"), question.alias("q"), answer.alias("a")).orderBy(F.length("q") + F.length("a"), "id", "q", "a")
    held: list = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == SHARD_ITEMS:
            if (index := build_index(*map(list, zip(*held)))) is not None:
                yield index
            held = []
    if held and (index := build_index(*map(list, zip(*held)))) is not None:
        yield index


def _lowered(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(text.fill_null(""))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row for each document: id, contaminated, items (sorted ids), overlap (best share of question shingles).

    Items are the stated query set's other side: they are indexed in shards of SHARD_ITEMS, each broadcast (its bound is the shard's
    size), and every passage of every document is run against every shard, in one pass over the text without a shuffle.
    Null and empty texts hold nothing; null ids and repeated rows are judged row by row; with no items nothing is contaminated.
    Item ids come as long where they are whole numbers of any width, else as text; a null one is last in a list.
    """
    context = docs.sparkSession.sparkContext
    listed = "bigint" if items.schema[item_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    typed = items.withColumn(item_col, F.col(item_col).cast(listed))
    shards = [context.broadcast(index) for index in item_shards(typed, item_col, question_col, answer_col)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = [{} for _ in range(batch.num_rows)]
            for i, _, data, offsets in pieces(_lowered(batch.column(1))):
                for shard in shards:
                    for doc, found in found_in(shard.value, data, offsets).items():
                        held[i + doc].update(found)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "contaminated": pa.array([bool(h) for h in held], pa.bool_()),
                "items": pa.array([sorted(h, key=lambda i: (i is None, i)) for h in held], pa.list_(pa.int64() if listed == "bigint" else pa.string())),
                "overlap": pa.array([max((r[0] for r in h.values()), default=0.0) for h in held], pa.float64()),
            })

    return rows.mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, contaminated boolean, items array<{listed}>, overlap double")


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item; a filter without a shuffle."""
    context = docs.sparkSession.sparkContext
    shards = [context.broadcast(index) for index in item_shards(items, item_col, question_col, answer_col)]
    at = docs.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for i, _, data, offsets in pieces(_lowered(batch.column(at))):
                for shard in shards:
                    clean[[i + doc for doc in found_in(shard.value, data, offsets)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
