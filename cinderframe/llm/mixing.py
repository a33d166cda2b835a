"""Mixing to target weights with soft domain membership and distributed projected gradient."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cinderframe.llm.common import pieces, sums, text_rows
from cinderframe.session import written

#: At most so many labelled documents train the domain classifier.
TRAIN_DOCS = 2000
BUCKETS = 4096
#: Byte pairs to feature buckets.
BUCKET_OF = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.uint16)
STEPS, RATE = 150, 0.05
#: Rounds at most, the gap to a target (as a share of all tokens) that is close, the least a round must lower the loss by to go on.
ROUNDS, CLOSE, STALLED = 200, 1e-4, 1e-6
#: How much the total may grow over the least one, as documents that repeat for one domain hold a little of others too.
GROWTH = 1.05


@dataclass
class DomainModel:
    """Multinomial logistic regression over byte-pair frequencies of a line."""

    domains: list[str]
    weight: np.ndarray
    bias: np.ndarray


def _pairs(data: np.ndarray) -> np.ndarray:
    code = np.zeros(len(data), np.uint16)
    code[1:] = BUCKET_OF[(data[:-1].astype(np.uint32) << 8) | data[1:]]
    return code


def frequencies(text: str) -> np.ndarray:
    """Shares of the byte-pair buckets in a whole text; zeros for an empty one."""
    data = np.frombuffer(text.encode(), np.uint8)
    count = np.zeros(BUCKETS)
    for i in range(0, len(data), 1 << 20):  # a pair over the border of two parts belongs to the second
        part = _pairs(data[max(i - 1, 0) : i + (1 << 20)])
        count += np.bincount(part[1:] if i else part, minlength=BUCKETS)
    return (count / max(len(data), 1)).astype(np.float32)


def train(texts: list[str], labels: list[int], domains: list[str]) -> DomainModel:
    return train_on([frequencies(t) for t in texts if t], [y for t, y in zip(texts, labels) if t], domains)


def train_on(seen: list[np.ndarray], labels: list[int], domains: list[str]) -> DomainModel:
    """Weights from the byte-pair frequencies of labelled texts."""
    model = DomainModel(domains, np.zeros((BUCKETS, len(domains)), np.float32), np.zeros(len(domains), np.float32))
    if not len(seen):
        return model
    seen = np.array(seen, np.float32)
    target = np.eye(len(domains), dtype=np.float32)[labels]
    scale = 1 / np.sqrt((seen * seen).mean(0) + 1e-8)
    seen *= scale
    first = [np.zeros_like(model.weight), np.zeros_like(model.bias)]
    second = [np.zeros_like(model.weight), np.zeros_like(model.bias)]
    for step in range(1, STEPS + 1):
        guess = _softmax(seen @ model.weight + model.bias)
        slopes = [seen.T @ (guess - target) / len(seen) + 1e-3 * model.weight, (guess - target).mean(0)]
        for k, (slope, held) in enumerate(zip(slopes, (model.weight, model.bias))):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope * slope
            held -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6) * (0.02 if k == 0 else 1)
    model.weight = (model.weight * scale[:, None]).astype(np.float32)
    return model


def _softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(1, keepdims=True))
    return grown / grown.sum(1, keepdims=True)


def posteriors(model: DomainModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Domain posteriors of every document, the length-weighted mean of its lines', and its count of words.

    A document of several languages belongs to each by its share of lines. One without text gets equal shares.
    """
    n, k = len(data), len(model.domains)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < n]
    mean = np.full((len(offsets) - 1, k), 1.0 / k)
    words = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return mean, words
    bounds = np.append(starts, n)
    length = np.diff(bounds)
    logits = sums(model.weight[_pairs(data)], bounds) / length[:, None] + model.bias
    weighted = _softmax(logits) * length[:, None]
    line_doc = np.searchsorted(starts, offsets)
    total = sums(length.astype(np.float64), line_doc)
    full = total > 0
    mean[full] = sums(weighted, line_doc)[full] / total[full, None]
    white = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~white
    begins[1:] &= white[:-1]
    begins[offsets[:-1][offsets[:-1] < n]] = ~white[offsets[:-1][offsets[:-1] < n]]
    words = np.rint(sums(begins.astype(np.float64), offsets)).astype(np.int64)
    return mean, words


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DomainModel:
    """Train on a bounded sample: the TRAIN_DOCS labelled ids of the smallest hash, one row of each, with their whole texts.

    Tasks make the byte-pair frequencies, so what reaches the driver has their size whatever the length of the texts. Of several rows of
    one id the one with text of the smallest hash counts.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain")).filter("id is not null")
    known = known.filter(F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    rows = text_rows(docs, id_col, text_col).filter("text <> ''").join(F.broadcast(chosen), "id")  # TRAIN_DOCS rows of an id and a name
    rows = rows.select("id", "domain", F.xxhash64("text").alias("code"), "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([frequencies(text.as_py()).tobytes() for text in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["id", "domain", "code", "seen"])

    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {id_type}, domain string, code long, seen binary")
    sample = counted.groupBy("id", "domain").agg(F.min_by("seen", "code").alias("seen")).collect()
    sample.sort(key=lambda r: (r["id"], r["domain"]))
    return train_on([np.frombuffer(r["seen"], np.float32) for r in sample], [domains.index(r["domain"]) for r in sample], domains)


def with_members(docs: DataFrame, model: DomainModel, name: str, text_col: str = "text") -> DataFrame:
    """`docs`, all columns, and `name`: a struct of tokens (words) and member (domain posteriors), in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kind = T.StructType.fromDDL("tokens long, member array<double>")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(at).fill_null("")
            found = [posteriors(shared.value, data, offsets) for _, _, data, offsets in pieces(text)]
            member = np.concatenate([m for m, _ in found]).astype(np.float64)
            ends = pa.array(np.arange(len(member) + 1, dtype=np.int32) * member.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(member.ravel()))
            both = pa.StructArray.from_arrays([pa.array(np.concatenate([w for _, w in found])), lists], ["tokens", "member"])
            yield pa.RecordBatch.from_arrays([*batch.columns, both], [*batch.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def rate_of(member: Column, steps: list[list[float]], least: float) -> Column:
    """A document's rate: from 1, one projected step after the other, each along the document's posteriors."""
    start = F.greatest(F.lit(1.0), F.lit(float(least)))
    if not steps:
        return start
    dot = lambda step: F.aggregate(F.zip_with(member, step, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)
    moves = F.array(*[F.array(*map(F.lit, step)) for step in steps])
    return F.aggregate(moves, start, lambda r, step: F.greatest(r - dot(step), F.lit(float(least))))


def fit_steps(members: DataFrame, targets: list[float], grow: bool = False, least: float = 0.0) -> tuple[list[list[float]], list[float], list[float]]:
    """The step vectors that lead every document (tokens, member) to its rate; the domain totals reached and those wanted.

    Least squares: half the sum over domains of (total of rate x tokens x posterior, less its target) squared over the target,
    rates at or above `least`. Every document starts at 1 and has a rate of its own; a round is one distributed sum of as many
    numbers as there are domains, from which the same step vector follows for all. A rate is a fold over these vectors, so no state
    is kept between rounds and a lost executor costs a re-read. The total of tokens stays what it is or, with `grow`, becomes the smallest
    at which no domain has to shrink; as documents that repeat hold a little of other domains, it may follow these by up to GROWTH.

    Steps are scaled by the inverse of the domains' second moments over the documents whose rates are free to move, which is part of
    the same sum; where such a step lowers the loss by less than half, a plain gradient step follows from the place before it. Rounds end when
    all targets are met to CLOSE, or when none can be met better; then what was reached tells the gap.

    A target of 0 pushes a domain's documents towards `least`. Documents without tokens get the rate of their posteriors but weigh
    nothing. With no tokens at all, all rates stay at 1.
    """
    k = len(targets)
    weight = np.array(targets, float) / sum(targets)

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of every domain, its second moments with the others over free documents, and over all."""
        rates = members.select("tokens", "member", rate_of(F.col("member"), steps, least).alias("rate"))
        free = (F.col("rate") > least).cast("double")
        pair = [F.col("tokens") * F.col("member")[i] * F.col("member")[j] for i in range(k) for j in range(k)]
        found = rates.agg(
            *[F.sum(F.col("rate") * F.col("tokens") * F.col("member")[i]) for i in range(k)], *[F.sum(free * p) for p in pair], *[F.sum(p) for p in pair]
        ).first()
        found = np.array([x or 0.0 for x in found])
        return found[:k], found[k : k + k * k].reshape(k, k), found[k + k * k :].reshape(k, k)

    steps: list[list[float]] = []
    reached, moving, gram = totals(steps)
    if not reached.sum():
        return steps, [0.0] * k, [0.0] * k
    needed = lambda reached: max(r / w for r, w in zip(reached, weight) if w > 0)
    total = needed(reached) if grow else reached.sum()
    most = GROWTH * total
    wanted = weight * total
    floor = np.maximum(wanted, 1e-3 * total)
    root = np.sqrt(floor)
    scaled = lambda moments: moments / np.outer(root, root)
    size = 1 / max(np.linalg.eigvalsh(scaled(gram)).max(), 1e-12)
    loss = lambda reached: (((reached - wanted) / root) ** 2).sum()
    rounds = 0
    while np.abs(reached - wanted).max() > CLOSE * total and rounds < ROUNDS:
        # at the start every rate may rise, so with rates at `least` all documents count as free
        moments = scaled(moving if moving.any() and steps else gram)
        fast = np.linalg.pinv(moments, rcond=1e-9, hermitian=True) @ ((reached - wanted) / root) / root
        before = loss(reached)
        found = totals([*steps, fast.tolist()])
        rounds += 1
        if loss(found[0]) <= before / 2:
            steps.append(fast.tolist())
        else:
            slow = (size * (reached - wanted) / floor).tolist()
            found = totals([*steps, slow])
            rounds += 1
            if loss(found[0]) > before * (1 - STALLED):
                break
            steps.append(slow)
        reached, moving, _ = found
        if grow and total < needed(reached) <= most:
            total = needed(reached)
            wanted = weight * total
    return steps, reached.tolist(), wanted.tolist()


def _told(reached: list[float], wanted: list[float]) -> None:
    gap = np.abs(np.array(reached) - wanted).max(initial=0)
    if gap > CLOSE * sum(wanted):
        warnings.warn(f"targets of the mix are missed by up to {gap / sum(wanted):.2%} of all tokens: reached {reached}, wanted {wanted}")


def mixed(docs: DataFrame, model: DomainModel, targets: list[float], grow: bool = False, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens, member, rate and copies of every row; copies is the rate rounded up or down by a hash of the id and the text."""
    rows = text_rows(docs, id_col, text_col)
    chance = (F.pmod(F.xxhash64("id", "text"), F.lit(1 << 53)) / float(1 << 53)).alias("chance")
    members = with_members(rows, model, "found").select("id", "found.tokens", "found.member", chance)
    members = written(members, "mix-members")
    steps, reached, wanted = fit_steps(members, targets, grow, least)
    _told(reached, wanted)
    rated = members.withColumn("rate", rate_of(F.col("member"), steps, least))
    return rated.withColumn("copies", F.floor(F.round("rate", 6) + F.col("chance")).cast("int")).drop("chance")


def mix_rows(docs: DataFrame, model: DomainModel, targets: list[float], grow: bool = False, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, each as often as its copies; texts are scored in place and never shuffled."""
    found = next(n for n in (f"found{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = with_members(docs, model, found, text_col)
    members = written(rows.select(f"{found}.tokens", f"{found}.member"), "mix-members")
    steps, reached, wanted = fit_steps(members, targets, grow, least)
    _told(reached, wanted)
    chance = F.pmod(F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 53)) / float(1 << 53)
    copies = F.floor(F.round(rate_of(F.col(f"{found}.member"), steps, least), 6) + chance).cast("int")
    repeated = rows.withColumn(found, F.explode(F.array_repeat(F.lit(True), copies)))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
