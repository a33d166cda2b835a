"""Near-duplicate documents by minhash with tensored tables: a table's key combines one code of each of two small collections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cinderframe.llm.common import pieces, text_rows
from cinderframe.llm.ngram_jaccard import ODD, _mix, _parities, linked_documents, shingle_sets
from cinderframe.plans.components import components
from cinderframe.session import dealt, written

#: Codes of each collection and minhashes of each code. Two collections give CODES ** 2 tables of 2 * ROWS minhashes for 2 * CODES * ROWS
#: minhashes instead of 2 * CODES ** 2 * ROWS. A pair of similarity s shares a table with chance (1 - (1 - s ** ROWS) ** CODES) ** 2.
CODES, ROWS = 18, 3
#: How many standard deviations below its mean a pair's share of equal minhashes may lie before it is given up.
SIGMAS = 7
#: Members of a group that are compared with its centre in one place.
TOGETHER = 256


def minhashes(codes: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """(count, sets) least values of `count` orders over the sets codes[offsets[k]:offsets[k+1]], none of them empty."""
    rng = np.random.default_rng(12)
    found = np.empty((count, len(offsets) - 1), np.uint64)
    turned = np.empty_like(codes)
    for k, (flip, factor) in enumerate(zip(rng.integers(0, 1 << 63, count, np.uint64), rng.integers(0, 1 << 63, count, np.uint64) | np.uint64(1))):
        np.bitwise_xor(codes, flip, out=turned)
        np.multiply(turned, factor, out=turned)
        np.minimum.reduceat(turned, offsets[:-1], out=found[k])
    return found


def collections(least: np.ndarray, size: int, rows: int) -> np.ndarray:
    """(2, size, sets) codes, each of `rows` minhashes, its collection and its place in it."""
    steps = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5][:rows], np.uint64)
    joined = (_mix(least.reshape(2 * size, rows, -1)) * steps[:, None]).sum(1, dtype=np.uint64)
    return _mix(joined + np.arange(2 * size, dtype=np.uint64)[:, None]).reshape(2, size, -1)


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _shingles(words: list[bytes], width: int) -> set:
    """Distinct runs of `width` words; all words where there are fewer."""
    return set(zip(*[words[k:] for k in range(width)])) if len(words) >= width else {tuple(words)} if words else set()


def _described(rows: DataFrame, width: int) -> DataFrame:
    """row, id, digest of the words, n, parities, signature (a byte of each minhash), both collections, and the text in zstd."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        count = 2 * CODES * ROWS
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(2)):
                sets = shingle_sets(data, offsets, width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                signature = np.zeros((len(sets), count), np.uint8)
                halves = np.zeros((2, len(sets), CODES), np.int64)
                if len(full):
                    least = minhashes(np.concatenate(sets), np.concatenate([[0], np.cumsum(n[full])]), count)
                    signature[full] = (_mix(least) & np.uint64(255)).astype(np.uint8).T
                    halves[:, full] = collections(least, CODES, ROWS).view(np.int64).transpose(0, 2, 1)
                odd = np.stack([_parities(s) for s in sets])
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * CODES)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                        pa.array([hashlib.sha256(b" ".join(_words(t))).digest() for t in texts], pa.binary()), pa.array(n),
                        *[pa.array(o) for o in odd.T], pa.array([s.tobytes() for s in signature], pa.binary()),
                        *[pa.ListArray.from_arrays(ends, pa.array(h.ravel())) for h in halves], pa.array([press.compress(t) for t in texts], pa.binary()),
                    ],
                    ["row", "id", "digest", "n", *ODD, "signature", "left", "right", "body"],
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "text")
    odd = ", ".join(f"{c} long" for c in ODD)
    shape = f"row long, id long, digest binary, n long, {odd}, signature binary, left array<long>, right array<long>, body binary"
    return numbered.mapInArrow(describe, shape)


def _fits(percent: int) -> str:
    """SQL over na, nb and parities: whether a pair can be a link at all. Sets differ in as many codes as parities, at least."""
    least = f"cast(ceil({percent} * (na + nb) / {100 + percent}.0D - 1e-9) as long)"
    apart = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in ODD)
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {apart} <= na + nb - 2 * {least}"


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes, parities and signatures allow a link."""
    share, count = percent / 100, 2 * CODES * ROWS
    least = int(count * share - SIGMAS * (count * share * (1 - share)) ** 0.5)

    def side(x: str) -> DataFrame:
        return classes.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"signature_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ODD])

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, count) for c in (2, 3))
                enough = np.count_nonzero(one == two, axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(enough))

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_fits(percent))
    return both.select("a", "b", "signature_a", "signature_b").mapInArrow(alike, "a long, b long")


def _verified(pairs: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles, as words of the whole texts, overlap enough.

    The members of a centre `a` are dealt out TOGETHER at a time, so a centre's text moves once for that many, not for every pair, and no
    group has to fit one task. Each task reads its sorted rows as a stream and holds one centre.
    """
    pairs = written(pairs, "tensor-pairs")
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).alias("slots"))
    placed = pairs.join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), "slots")).drop("slots")
    members = placed.join(bodies.withColumnRenamed("row", "b"), "b").select("a", "slot", "b", "body")
    centres = placed.select("a", "slot").distinct().join(bodies.withColumnRenamed("row", "a"), "a")
    rows = centres.select("a", "slot", F.lit(None).cast("long").alias("b"), "body").unionByName(members)
    rows = rows.repartition("a", "slot").sortWithinPartitions("a", "slot", F.asc_nulls_first("b"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, centre = zstandard.ZstdDecompressor(), set()
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for a, b, body in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                found = _shingles(_words(press.decompress(body)), width)
                if b is None:
                    centre = found
                    continue
                same = len(centre & found)
                if 100 * same >= percent * (len(centre) + len(found) - same):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[x] for p in kept], pa.int64()) for x in (0, 1)], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """class, root: the least class reachable over links."""
    roots = components(links).withColumnRenamed("node", "class")
    return written(classes.select("class").join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("root")), "tensor-roots")


def _open(classes: DataFrame, rooted: DataFrame) -> DataFrame:
    """row: the classes that may share one of all CODES ** 2 tables with a class of another component.

    A code whose holders all have one root links nothing, nor does any key made of it. A class without another code on both sides has no
    key left that could tell something new.
    """
    sides = classes.select("class", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(name).alias("codes")) for side, name in enumerate(("left", "right"))])).alias("s"))
    codes = sides.join(rooted, "class").select("root", "s.side", F.explode("s.codes").alias("code"))
    roots = codes.groupBy("code", "side").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("code", "side")
    holders = sides.select("class", "s.side", F.explode("s.codes").alias("code")).join(roots, ["code", "side"])
    both = holders.groupBy("class").agg(F.min("side").alias("first"), F.max("side").alias("last")).filter("first < last")
    return both.select(F.col("class").alias("row"))


def _settled(rows: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked among `rows`, by the grouped prefix join: exact, and without pairs by key."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([press.decompress(body) for body in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])

    texts = written(bodies.join(rows, "row", "left_semi").mapInArrow(unpack, "row long, text string"), "tensor-crowded")
    found = linked_documents(texts, "row", "text", width, percent)
    return found.filter("component <> id").select(F.col("component").alias("a"), F.col("id").alias("b"))


def linked_by_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """id, n_shingles, component (smallest id reachable over links) and kept (id = component) of every row.

    Texts link when their sets of `width`-word shingles have a Jaccard similarity of `percent` / 100 at least. Words are runs of other
    bytes than [\\x20\\x09-\\x0D], A-Z in lower case; fewer than `width` words are one shingle.

    1. Rows of equal words (by sha256) are one class, told by its least row.
    2. Classes that share a key of one of the CODES tables (i, i) are compared with the least of their key and size.
    3. Of all CODES ** 2 tables only the keys matter whose two codes are both held by several components. Where many documents share much but
       do not link (one passage in all of them), such keys would make pairs by the square of their holders. The holders of such codes on both
       sides are settled by the grouped prefix join instead, which is exact: it looks at rare shingles, not at what all of them share.

    Texts move once, into a table in buckets by row, which all steps read in place; what meets it is ids of rows.

    Only classes that share a table meet, and pairs within a component are skipped, so a group of copies costs a pair for each
    member. Pairs go through the exact bounds of sizes and parities, then the share of equal minhashes, then both whole texts, word by word.
    A pair of similarity 0.8 shares a table but for a chance of about 5e-6, and passes the signature but for less than 1e-9.

    Null and empty texts have no shingles and link with nothing. A null id has no component and is kept. Rows that repeat an id are one
    document: what any of them links with, all do. An empty table gives an empty result.
    """
    base = dealt(_described(text_rows(docs, id_col, text_col), width), "tensor-rows", "row")
    usable = base.filter("id is not null and n > 0")
    heads = dealt(usable.groupBy("digest").agg(F.min("row").alias("class")), "tensor-heads", "class")
    classes = base.drop("digest").join(heads.withColumnRenamed("class", "row"), "row").withColumnRenamed("row", "class")
    bodies = base.select("row", "body")
    named = written(usable.select("id", "digest").join(heads, "digest").select("id", "class"), "tensor-named")

    twice = named.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("id", "a")
    links = named.join(twice, "id").select("a", F.col("class").alias("b")).filter("a <> b").distinct()

    # 2: the tables (i, i)
    pairs_of = F.transform("left", lambda code, at: F.xxhash64(code, F.get("right", at)))
    band = F.floor(F.log("n") / float(-np.log(percent / 100))).cast("int")
    listed = classes.select("class", band.alias("band"), F.explode(pairs_of).alias("key"))
    centres = listed.groupBy("key", "band").agg(F.min("class").alias("a"), F.count("*").alias("held")).filter("held > 1").drop("held")
    stars = listed.join(centres, ["key", "band"]).select("a", F.col("class").alias("b")).filter("a <> b").distinct()
    links = written(links.unionByName(_verified(_likely(stars, classes, percent), bodies, width, percent)), "tensor-links")
    rooted = _rooted(classes, links)

    # 3: all tables
    links = links.unionByName(_settled(_open(classes, rooted), bodies, width, percent))
    rooted = _rooted(classes, links)

    least = named.join(rooted, "class").groupBy("root").agg(F.min("id").alias("component"))
    found = heads.join(rooted, "class").join(least, "root").select("digest", "component")
    rows = base.select("id", "digest", "n")
    linked = rows.filter("id is not null and n > 0").join(found, "digest").select("id", "n", "component")
    alone = rows.filter("id is null or n = 0").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select("id", F.col("n").alias("n_shingles"), "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))
