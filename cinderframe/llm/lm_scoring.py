"""Language-model scores: word counts of the training folds, and a causal self-attention model on subword ids."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cinderframe.llm import attention
from cinderframe.llm.attention import BASE, BEFORE, INPUTS, LEVELS, NEAR, OUTPUTS, PAD
from cinderframe.llm.common import text_rows
from cinderframe.session import written

#: Text bytes of a block; rounds of training, each over another part of a block's windows, together over all of them.
BLOCK_BYTES = 12 << 20
ROUNDS = 2
#: Subwords of the last output class that are counted one by one behind each input class, the others together.
NAMED = NEAR * BASE ** (LEVELS - 1)


@lru_cache(maxsize=2)
def _subwords(ranks_path: str, pattern: str):
    """A byte-level encoder over a file of ranks, and which of its ids begin with a space."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    begins = np.zeros(max(ranks.values()) + 1, bool)
    begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), begins


def word_subwords(words: list[bytes], encoder: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words behind each other, each with a space in front, and how many each has.

    The encoder never joins what stands in front of a space with it, so the words are encoded as one text and told apart by the ids that
    begin with a space.
    """
    known, begins = _subwords(*encoder)
    ids = [np.array(known.encode_ordinary((b" " + b" ".join(words[i : i + 4096])).decode()), np.uint16) for i in range(0, len(words), 4096)]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    lengths = np.diff(np.append(np.flatnonzero(begins[flat]), len(flat))).astype(np.uint32)
    assert len(lengths) == len(words) and lengths.sum(dtype=np.int64) == len(flat), "subwords of words do not add up"
    return flat, lengths


def _blocks(rows: DataFrame, encoder: tuple[str, str]) -> DataFrame:
    """Documents in blocks of about BLOCK_BYTES: their words as numbers into the block's list of words, those words' counts in
    training documents and subword ids. Word counts, subword statistics, training and scoring all read this table; the text is read once."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, nth = zstandard.ZstdCompressor(level=1), 0

        def block(ids: list, held: list, sizes: list[int], stream: list[np.ndarray], words: dict[bytes, int]) -> pa.RecordBatch:
            nonlocal nth
            place = np.concatenate(stream) if stream else np.zeros(0, np.uint32)
            learned = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(place[learned], minlength=len(words))
            names = list(words)
            pieces_, lengths = word_subwords(names, encoder)
            number = (TaskContext.get().partitionId() << 32) | nth
            nth += 1
            body = [press.compress(x.tobytes()) for x in (place, np.array(sizes, np.uint32), lengths, pieces_, np.array(held, np.uint8))]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.list_(pa.binary())), pa.array([names], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts.astype(np.int64)))],
                ["block", "ids", "body", "words", "counts"],
            )

        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        ids, held, sizes, stream, size = [], [], [], [], 0
        for batch in batches:
            for key, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py().encode()
                if size and size + len(data) > BLOCK_BYTES:
                    yield block(ids, held, sizes, stream, words)
                    words = defaultdict()
                    words.default_factory = words.__len__
                    ids, held, sizes, stream, size = [], [], [], [], 0
                found = data.lower().split()
                stream.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                ids.append(key)
                held.append(fold)
                sizes.append(len(found))
                size += len(data)
        if ids:
            yield block(ids, held, sizes, stream, words)

    blocks = rows.mapInArrow(cut, "block long, ids array<long>, body array<binary>, words array<binary>, counts array<long>")
    return written(blocks, "lm-blocks")


def _opened(body: pa.ListScalar) -> tuple[np.ndarray, ...]:
    """Word numbers of all documents, documents' sizes, words' subword counts, words' subword ids, folds."""
    press = zstandard.ZstdDecompressor()
    kinds = (np.uint32, np.uint32, np.uint32, np.uint16, np.uint8)
    return tuple(np.frombuffer(press.decompress(part), kind) for part, kind in zip(body.as_py(), kinds))


def _sequences(place: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, subwords: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of documents behind each other, each with an end, and their lengths."""
    starts = np.cumsum(lengths.astype(np.int64)) - lengths
    size = lengths[place].astype(np.int64)
    first = np.cumsum(size) - size
    flat = subwords[np.repeat(starts[place] - first, size) + np.arange(size.sum())].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])]
    return np.insert(flat, bounds[1:], end), np.diff(bounds) + 1


def _backed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities from counts, with a weight on the shorter context that grows with the number of kinds seen (Witten-Bell)."""
    kinds = (counts > 0).sum(-1, keepdims=True) + 1
    return (counts + kinds * lower) / (counts.sum(-1, keepdims=True) + kinds)


class Classes:
    """Subword ids as input and output codes of the attention model, both by rank in frequency.

    Frequent subwords are classes of their own; all others are numbers in the last class, which the model tells apart by their digits.
    """

    def __init__(self, counts: np.ndarray, end: int):
        if len(counts) > OUTPUTS - 1 + BASE**LEVELS:
            raise ValueError(f"{LEVELS} digits below {BASE} do not tell {len(counts)} subwords apart")
        order = np.argsort(-counts, kind="stable")
        order = np.concatenate([[end], order[order != end]])
        self.end = end
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.input = np.where(rank < INPUTS - 1, rank, rank - (INPUTS - 1) + PAD + 1)
        self.output = np.where(rank < OUTPUTS - 1, rank, rank - (OUTPUTS - 1) + OUTPUTS)
        rest = counts[order[OUTPUTS - 1 :]] + 0.5
        self.alone = np.zeros(BASE**LEVELS)
        self.alone[: len(rest)] = rest / rest.sum()

    def rest(self, counts: np.ndarray) -> list[np.ndarray]:
        """Log probabilities of digits, as attention takes them, from counts[input class, number of the subword below NAMED, or NAMED]."""
        beyond = self.alone[NAMED:].reshape(-1, BASE ** (LEVELS - 1)).sum(1)
        held = _backed(counts, np.append(self.alone[:NAMED], beyond.sum()))
        near, tables = held[:, :NAMED], []
        for level in range(LEVELS):
            behind = near.reshape(-1, NEAR if level == 0 else BASE, BASE ** (LEVELS - 1 - level)).sum(2)
            if level == 0:
                behind = np.concatenate([behind, held[:, NAMED:] * beyond / max(beyond.sum(), 1e-300)], 1)
            each = np.concatenate([behind, self.alone.reshape(BASE**level, BASE, -1).sum(2)])
            tables.append(np.log(each / np.maximum(each.sum(1, keepdims=True), 1e-300) + 1e-12))
        return tables

    def pairs(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input code in front of every subword, an end in front of the first, and the subword's output code."""
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[np.cumsum(lengths) - lengths] = self.end
        return self.input[before], self.output[flat]


def _learned(block: tuple[np.ndarray, ...], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of a block's training documents."""
    place, sizes, lengths, subwords, held = block
    keep = np.repeat(held == 0, sizes)
    return _sequences(place[keep], sizes[held == 0], lengths, subwords, end)


def _fit(blocks: DataFrame, vocabulary: int, end: int) -> tuple[Classes, attention.Attention]:
    """Subword, pair and triple counts of all training documents; then rounds of training in every block, averaged by windows used.

    Each block starts a round from the same weights and trains on those of its windows that the round is for; the weighted mean of all blocks' weights
    is a distributed sum. So what is gathered grows with the documents, while what reaches the driver has the model's size.
    """
    context = blocks.sparkSession.sparkContext

    def singles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                flat, _ = _learned(_opened(body), end)
                count = np.bincount(flat, minlength=1)
                found = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count[found])], ["id", "n"])

    counts = np.zeros(vocabulary)
    for row in blocks.select("body").mapInArrow(singles, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    classes = Classes(counts, end)
    shared_classes = context.broadcast(classes)

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared_classes.value
        for batch in batches:
            for body in batch.column(0):
                flat, lengths = _learned(_opened(body), end)
                before, behind = classes.pairs(flat, lengths)
                before = np.where(before > PAD, INPUTS - 1, before)
                second = np.full(len(before), BEFORE - 1, np.int64)
                second[1:] = np.minimum(before[:-1], BEFORE - 1)
                second[np.cumsum(lengths) - lengths] = BEFORE - 1
                rest = behind >= OUTPUTS
                numbers = np.minimum(behind[rest] - OUTPUTS, NAMED)
                for kind, codes in ((0, (second * INPUTS + before) * OUTPUTS + np.minimum(behind, OUTPUTS - 1)), (1, before[rest] * (NAMED + 1) + numbers)):
                    found, count = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind)), pa.array(found), pa.array(count)], ["kind", "code", "n"])

    found = blocks.select("body").mapInArrow(contexts, "kind long, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    kind, code, n = (found.column(k).to_numpy() for k in ("kind", "code", "n"))
    triple, rest = np.zeros((BEFORE, INPUTS, OUTPUTS), np.float32), np.zeros((INPUTS, NAMED + 1))
    np.put(triple, code[kind == 0], n[kind == 0])
    np.put(rest, code[kind == 1], n[kind == 1])
    pair = triple.sum(0)
    alone = (pair.sum(0) + 1) / (pair.sum() + OUTPUTS)
    pair = _backed(pair, alone)
    triple = np.log(_backed(triple, pair))
    model = attention.fresh(triple, classes.rest(rest))
    for number in range(ROUNDS if counts.any() else 0):
        shared = context.broadcast(model)

        def learn(batches: Iterable[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    flat, lengths = _learned(_opened(body), end)
                    own = attention.Attention(shared.value.triple, {n: w.copy() for n, w in shared.value.weights.items()}, shared.value.rest)
                    used = attention.train(own, *shared_classes.value.pairs(flat, lengths), lengths, number, ROUNDS, block % (1 << 31))
                    if used:
                        yield pa.RecordBatch.from_arrays([pa.array([float(used)]), pa.array([attention.flat(own.weights).tolist()])], ["used", "weights"])

        trained = blocks.select("block", "body").mapInArrow(learn, "used double, weights array<double>")
        mean = trained.select(Summarizer.mean(array_to_vector("weights"), F.col("used")).alias("mean"))
        found = mean.select(vector_to_array("mean").alias("mean")).first()[0]
        if not found or not np.isfinite(found).all():
            break
        model = attention.Attention(model.triple, attention.shaped(np.array(found)), model.rest)
    return classes, model


def lm_scores(docs: DataFrame, held: Column, encoder: tuple[str, str], vocabulary: int = 50257, end: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; `held`, over the column id, marks rows not to learn from;
    `encoder` is a file of byte-level ranks and its pattern, `vocabulary` the number of ids with the end.

    Words are runs of other bytes than [\\x20\\x09-\\x0D], A-Z in lower case; every document has an end besides. base_score: log10 of the words'
    probability by counts plus one. score: log10 of the probability of the document's subwords and end by the attention model.

    Word counts meet as (block, place, count) rows, one for each different word of a block, so a frequent word is as many rows as there are
    blocks. Null and empty texts are an end alone. Null and repeated ids are scored row by row. Without training documents the model
    is uniform over what it has not seen; an empty table gives an empty result.
    """
    rows = text_rows(docs, id_col, text_col).select("id", held.alias("held"), "text")
    blocks = _blocks(rows, encoder)
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "word"))
    each = each.select("block", F.col("place").cast("int"), F.col("word.words").alias("word"), F.col("word.counts").alias("n"))
    of_word = Window.partitionBy("word")
    each = each.select(
        "block", "place", "n", F.sum("n").over(of_word).alias("count"), (F.row_number().over(of_word.orderBy("block")) == 1).alias("first"),
    )
    each = written(each, "lm-counts")
    ends = blocks.select(F.explode("ids").alias("id")).select(held.alias("held")).filter("not held").count()
    words, kinds = each.agg(F.sum("n"), F.sum((F.col("first") & (F.col("count") > 0)).cast("long"))).first()
    train_tokens, kinds = (words or 0) + ends, (kinds or 0) + (ends > 0)
    classes, model = _fit(blocks, vocabulary, end)
    shared = docs.sparkSession.sparkContext.broadcast((classes, model))
    least = np.log10(train_tokens + kinds + 1)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        classes, model = shared.value
        out = []
        count = np.zeros(right.num_rows, np.int64)
        count[right.column("place").to_numpy()] = right.column("count").to_numpy()
        for ids, body in zip(left.column("ids"), left.column("body")):
            place, sizes, lengths, subwords, held = _opened(body)
            cuts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            known, logs = (np.concatenate([[0], np.cumsum(x[place])]) for x in (count > 0, np.log10(count + 1.0)))
            base = logs[cuts[1:]] - logs[cuts[:-1]] + np.log10(ends + 1.0) - (sizes + 1) * least
            total = np.zeros(len(sizes))
            done = 0
            while done < len(sizes):  # about half a million words at a time
                to = max(done + 1, int(np.searchsorted(cuts, cuts[done] + 500_000, "right")) - 1)
                flat, long = _sequences(place[cuts[done] : cuts[to]], sizes[done:to], lengths, subwords, classes.end)
                before, behind = classes.pairs(flat, long)
                found = attention.log_probabilities(model, before, behind, long).astype(np.float64)
                total[done:to] = np.add.reduceat(found, np.cumsum(long) - long) / np.log(10)
                done = to
            n = len(sizes)
            out.append(pa.table([
                pa.array(ids.as_py(), pa.int64()), pa.array(held == 1), pa.array(sizes.astype(np.int64) + 1),
                pa.array((known[cuts[1:]] - known[cuts[:-1]]).astype(np.int64) + int(ends > 0)), pa.array(np.full(n, train_tokens, np.int64)), pa.array(base), pa.array(total),
            ], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)], names)

    grouped = blocks.select("block", "ids", "body").groupBy("block").cogroup(each.select("block", "place", "count").groupBy("block"))
    return grouped.applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
