"""Near-duplicate documents by a grouped prefix join on word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cinderframe.llm.common import BASE, inverse, packed, pieces, powers, text_rows
from cinderframe.llm.components import components
from cinderframe.session import bounded_batches, dealt, dropped, written

#: Documents (about) whose shingles tell which are frequent, and the most frequent shingles that are told apart.
ORDER_DOCS, ORDER_SHINGLES, OFTEN = 4000, 100_000, 4
#: Columns of 64 parities each; a set's codes are dealt to the parities by their upper bits.
ODD = ["odd0", "odd1", "odd2", "odd3"]
CODE_OF = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE_BYTE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document of a piece the sorted distinct 64-bit codes of its shingles.

    Words are runs of other bytes than [\\x20\\x09-\\x0D], A-Z in lower case. A document of fewer than `width` words has one shingle, all
    its words; one without words has none.
    """
    inside = ~WHITE_BYTE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODE_OF[LOWER[data]] * powers(BASE, len(data)), out=total[1:])
    words = _mix((total[ends] - total[starts]) * powers(inverse(BASE), len(data) + 1)[starts])
    first = np.searchsorted(starts, offsets)
    sets = []
    steps = np.uint64(BASE) ** np.arange(1, width + 1, dtype=np.uint64)
    joined = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        joined += words[k : k + len(joined)] * steps[k]
    joined = _mix(joined)
    for i, j in zip(first[:-1], first[1:]):
        if j - i >= width:
            found = np.sort(joined[i : j - width + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif j > i:
            short = words[i:j] * steps[: j - i]
            sets.append(_mix(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(j - i)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


def _order(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of frequent shingles, ascending, with their count in a sample of about ORDER_DOCS documents.

    The counts only order shingles, rare ones first, so that prefixes are selective. Any order gives the same links.
    """
    n = rows.count()
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // ORDER_DOCS))) == 0)

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(1)):
                found, count = np.unique(np.concatenate(shingle_sets(data, offsets, width)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(count)], ["code", "count"])

    counted = picked.mapInArrow(codes, "code long, count long").groupBy("code").agg(F.sum("count").alias("count")).filter(F.col("count") >= OFTEN)
    top = counted.orderBy(F.desc("count"), "code").limit(ORDER_SHINGLES).collect()
    codes_, counts = np.array([r["code"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64)
    by_code = np.argsort(codes_)
    return codes_[by_code], counts[by_code]


def _sizes(percent: int) -> tuple[str, str]:
    """SQL over na, nb: whether the sizes allow a link; the least intersection of a link."""
    return (
        f"100 * least(na, nb) >= {percent} * greatest(na, nb)",
        f"cast(ceil({percent} * (na + nb) / {100 + percent}.0D - 1e-9) as long)",
    )


def _parities(codes: np.ndarray) -> np.ndarray:
    """For each of 64 x len(ODD) classes of codes, whether the set holds an odd number of them, as 64-bit words.

    Every code that only one of two sets holds flips one bit, so the words of two sets differ in at most as many bits as the sets
    have codes apart.
    """
    odd = np.bincount((codes >> np.uint64(40)).astype(np.int64) % (64 * len(ODD)), minlength=64 * len(ODD)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets, made anew from the whole texts, overlap enough."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b"
    )

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def sets(bodies: pa.Array) -> list[np.ndarray]:
            whole = pa.array([press.decompress(body.as_py()) for body in bodies], pa.large_binary())
            return [s for _, _, data, offsets in pieces(whole) for s in shingle_sets(data, offsets, width)]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = sets(part.column(2)), sets(part.column(3))
                same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64) - same
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(100 * same >= percent * union))

    return both.select("a", "b", "body_a", "body_b").mapInArrow(check, "a long, b long")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """id, n_shingles and component (smallest id reachable over links) of every row; texts link at a Jaccard of `percent` / 100.

    1. Documents of one shingle set, told by its size and two sums of codes, are one class; its smallest id stands for it.
    2. A class's prefix, its n - ceil(n x percent / 100) + 1 rarest shingles, meets that of every class it links with. Classes of equal size
       and prefix are one group; inverted lists hold groups.
    3. Groups of a list are paired with its smallest group in their band of sizes, and members with their group's smallest, filtered by how
       many prefix shingles such a pair has to share, and verified. That joins copies by the thousand with a pair for each.
    4. Lists that still hold several components are expanded to members, and members of different components are paired, under
       the size, position, parity and count filters, which no link fails. Verified pairs complete the components.

    So a link is skipped only where its ends are connected already. Pairs are verified on sets made anew from whole texts.
    What a step has written goes as soon as no later one reads it; texts and prefixes do not stay until the end.
    Shingles are compared by 64-bit codes. Null and empty texts have no shingles and link with nothing. A null id has no component.
    Rows that repeat an id are one document: what any of them links with, all do. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = text_rows(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    shared = spark.sparkContext.broadcast(_order(rows, width))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = shared.value
        for batch in batches:
            size, one, two, odd, prefixes = [], [], [], [np.zeros(0, np.int64)], []
            for _, _, data, offsets in pieces(batch.column(1)):
                for found in shingle_sets(data, offsets, width):
                    n = len(found)
                    size.append(n)
                    one.append(found.sum(dtype=np.uint64))
                    two.append(_mix(found + np.uint64(BASE)).sum(dtype=np.uint64))
                    odd.append(_parities(found))
                    if len(codes) and n:
                        place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                        often = np.where(codes[place] == found, counts[place], 0)
                        found = found[np.argsort(often, kind="stable")]
                    prefixes.append(_signed(found[: n - -(-n * percent // 100) + 1]) if n else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            signed = [pa.array(_signed(np.array(x, np.uint64))) for x in (one, two)]
            words = [pa.array(w) for w in np.concatenate(odd).reshape(-1, len(ODD)).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *signed, *words, prefix], ["id", "n", "one", "two", *ODD, "prefix"])

    numbers = ", ".join(f"{c} long" for c in ("id", "n", "one", "two", *ODD))
    base = written(rows.mapInArrow(describe, f"{numbers}, prefix array<long>"), "jaccard-sets")
    usable = base.filter("id is not null and n > 0")
    classes = usable.groupBy("n", "one", "two").agg(F.min(F.struct("id", *ODD, "prefix")).alias("kept"))
    prefixed = written(classes.select("n", "one", "two", "kept.*"), "jaccard-classes")
    classes = written(prefixed.drop("prefix"), "jaccard-classes")
    sets, base = base, written(base.select("id", "n", "one", "two"), "jaccard-sizes")
    dropped(spark, sets)
    keyed = prefixed.withColumn("key", F.xxhash64("prefix"))  # equal keys of different prefixes only pair more
    members = keyed.select("id", F.min("id").over(Window.partitionBy("n", "key")).alias("group"))
    members = written(members, "jaccard-members")
    fits, least = _sizes(percent)
    heads = prefixed.select("id", "n", "prefix").join(members.groupBy("group").count().withColumnRenamed("group", "id"), "id")
    listed = heads.select("id", "n", "count", F.posexplode("prefix").alias("at", "code"))
    band = F.floor(F.log("n") / float(-np.log(percent / 100))).cast("int")
    lists = listed.withColumn("held", F.sum("count").over(Window.partitionBy("code"))).filter("held > 1").drop("held", "count")
    lists = lists.withColumn("band", band)
    first = F.min(F.struct("id", "n")).over(Window.partitionBy("code", "band"))
    lists = written(lists.withColumn("first", first), "jaccard-lists")
    dropped(spark, prefixed)
    stars = lists.select(F.col("first.id").alias("a"), F.col("first.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))
    stars = stars.filter("a <> b").groupBy("a", "b", "na", "nb").count().filter(fits).withColumn("least", F.expr(least))
    enough = F.least(*[F.col("least") - F.ceil(F.col(x) * percent / 100.0 - 1e-9) + 1 for x in ("na", "nb")])
    stars = stars.filter(F.col("count") >= enough).select("a", "b")
    stars = written(stars.unionByName(members.filter("id <> group").select(F.col("group").alias("a"), F.col("id").alias("b"))), "jaccard-pairs")
    dropped(spark)
    listed_ids = members.join(lists.select(F.col("id").alias("group")).distinct(), "group", "left_semi").select("id")
    bodies = packed(rows.filter("id is not null"), "id").join(listed_ids.distinct(), "id", "left_semi")
    texts = dealt(bodies.groupBy("id").agg(F.max("body").alias("body")), "jaccard-texts", "id")
    links = written(_verified(stars, texts, width, percent), "jaccard-links")
    dropped(spark, stars)
    roots = written(components(links), "jaccard-roots")

    known = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "group", F.coalesce("root", "id").alias("root"))
    known = known.join(classes.select("id", *ODD), "id")
    wide = lists.select("code", "at", "n", F.col("id").alias("group")).join(known, "group")
    inside = Window.partitionBy("code")
    wide = wide.withColumn("low", F.min("root").over(inside)).withColumn("high", F.max("root").over(inside)).filter("low < high")
    wide = written(wide.drop("group", "low", "high"), "jaccard-mixed")
    dropped(spark, lists, members, roots)
    side = lambda x: wide.select(*[F.col(c).alias(f"{c}{x}") for c in wide.columns])
    # the first shingle that a link's ends share has at least the rest of the intersection behind it on both sides
    ahead = F.expr(f"{least} <= least(na - ata, nb - atb)")
    apart = " + ".join(f"bit_count({c}a ^ {c}b)" for c in ODD)
    alike = f"{apart} <= na + nb - 2 * {least}"
    pairs = side("a").join(side("b"), F.expr(f"codea = codeb and ida < idb and roota <> rootb and {fits} and {alike}"))
    # all that two prefixes share is in mixed lists, as their roots differ, so its rows are counted and no prefix moves
    pairs = pairs.groupBy(F.col("ida").alias("a"), F.col("idb").alias("b"), "na", "nb").agg(F.count(F.lit(1)).alias("count"), F.max(ahead).alias("ahead"))
    pairs = pairs.withColumn("least", F.expr(least)).filter("ahead").filter(F.col("count") >= enough)
    pairs = written(pairs.select("a", "b"), "jaccard-pairs")
    dropped(spark, wide)
    more = written(_verified(pairs, texts, width, percent), "jaccard-links")
    dropped(spark, pairs, texts)
    roots = components(links.unionByName(more))
    dropped(spark, links, more)

    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("n", "one", "two", F.coalesce("root", "id").alias("component"))
    alone = base.filter("id is null or n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    return base.filter("id is not null and n > 0").join(named, ["n", "one", "two"]).select("id", F.col("n").alias("n_shingles"), "component").unionByName(alone)
