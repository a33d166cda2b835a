"""Fill-in-the-middle cuts and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.checks.tables import normal_rows, oracle_rows
from cinderframe.llm import fill_in_middle as fim, queries, resampling
from cinderframe.llm.wavelet import WaveletMatrix

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, form string, id double, n int, rank boolean, words string, output int"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a <P> b"), (6, "<M>"), (7, "日本 É😀 ß\n" * 4000), (8, "ab" * 40000), (9, "<<S<S"), (-10, "one two " * 30),
    (11, "Ünï-cödé_x9 " * 40), (12, "\n\n\n"), (13, "z\n"), (14, "one two " * 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties; extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "f", 0.5, 1, True, "w", 3) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def repeated(odd):
    """Repeated rows and a null id."""
    return odd.unionByName(odd.filter("doc_id in (7, 14)")).unionByName(odd.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _piece(texts):
    held = [t.encode() for t in texts]
    return held, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)


def _random_texts(letters, seed):
    random.seed(seed)
    return ["".join(random.choice(letters) for _ in range(random.choice([0, 1, 5, 70, 200]))) for _ in range(200)]


# 11: fill in the middle


def test_ranks_of_a_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 3)
        for symbol in range(8):
            want = np.concatenate([[0], np.cumsum(symbols == symbol)])
            assert matrix.rank(symbol, np.arange(n + 1)).tolist() == want.tolist()


def _unit_ends(text, unit):
    """Byte places behind 0, 1, ... units."""
    data = text.encode()
    if unit == "char":
        return [len(text[:k].encode()) for k in range(len(text) + 1)]
    if unit == "word":
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        return [0, *starts[1:], len(data)] if starts else [0]
    ends = [0] + [m.end() for m in re.finditer(rb"\n", data)]
    return ends if ends[-1] == len(data) else [*ends, len(data)]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_cuts_at_every_unit(unit):
    texts = _random_texts("ab é\n\t日😀", 1)
    _, data, offsets = _piece(texts)
    cutter, ends = fim.Cutter(data, offsets), [_unit_ends(t, unit) for t in texts]
    assert cutter.counts(unit).tolist() == [len(e) - 1 for e in ends]
    for share in (0, 0.2, 0.5, 0.99, 1):
        units = np.array([int((len(e) - 1) * share) for e in ends])
        assert (cutter.places(unit, units) - offsets[:-1]).tolist() == [e[u] if u else 0 for e, u in zip(ends, units)]


def _rearranged(key, text, seed="1"):
    text = text or ""
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("source", ["odd", "repeated"])
def test_rearranged_texts_match_plain_version(request, source):
    docs = request.getfixturevalue(source)
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()), key=repr)
    want = sorted(((r.doc_id, *_rearranged(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_restore_and_cut_at_boundaries(odd, unit):
    made = fim.fill_in_middle(odd, unit=unit, rate=100).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    texts = dict(ODD)
    for r in made.collect():
        text = texts[r.id] or ""
        assert r.back == text and r.n == len(_unit_ends(text, unit)) - 1
        if r.form != "plain":
            ends = set(_unit_ends(text, unit)) | {0, len(text.encode())}
            cut = r.prefix_chars, r.prefix_chars + r.middle_chars
            assert {len(text[:c].encode()) for c in cut} <= ends


def test_rearranged_query_matches_sql(spark, empty):
    df = queries.op11_fill_in_middle(spark, FOLDER)
    assert normal_rows(df.columns, df.collect()) == normal_rows(*oracle_rows(FOLDER, queries.ORACLES["op11_fill_in_middle"]))
    assert fim.fill_in_middle(empty).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(empty, unit="page")


# 13: importance resampling


def test_checksums_of_spans():
    random.seed(5)
    data = np.frombuffer(random.randbytes(6000), np.uint8)
    starts = np.array([random.randrange(6000) for _ in range(3000)])
    ends = np.minimum(6000, starts + np.array([random.choice([0, 1, 2, 31, 32, 33, 63, 64, 65, 96, 97, 2000]) for _ in starts]))
    assert resampling.crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.crc32_spans(data, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text, longest=1, buckets=10_000):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[k : k + m]).encode()) % buckets for m in range(1, longest + 1) for k in range(len(words) - m + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_buckets_match_plain_version(longest):
    texts = _random_texts("aB É9z-日😀_ ", 2)
    _, data, offsets = _piece(texts)
    found, bounds = resampling.buckets_of(data, offsets, longest, 10_000)
    for k, text in enumerate(texts):
        assert Counter(found[bounds[k] : bounds[k + 1]].tolist()) == Counter(_features(text, longest)[1])


def _resampled(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    s, t, made = Counter(), Counter(), []
    for _, text in rows:
        s.update(_features(text, longest, buckets)[1])
    for text in target:
        t.update(_features(text, longest, buckets)[1])
    here, there = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * here / ((s[b] + 1) * there))) for b in range(buckets)}
    for key, text in rows:
        words, found = _features(text, longest, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        made.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    order = sorted((m for m in made if m[4]), key=lambda m: (-m[3], m[0] is None, m[0] or 0))
    ranks = Counter()
    out = [(*m[:4], None) for m in made if not m[4]]
    for place, m in enumerate(order, 1):
        out.append((*m[:4], place if place <= len(order) * percent // 100 else None))
    return sorted(out, key=repr)


def _collected(df):
    return sorted((tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_resampling_query_matches_plain_version(spark, folder):
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    want = _resampled([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    got = queries.op13_importance_resampling(spark, folder).withColumnRenamed("doc_id", "id")
    assert _collected(got) == want
    assert dict(got.dtypes) == dict.fromkeys(["id", "n_features", "weight", "score", "rank"], "bigint")
    assert sum(row[4] is not None for row in want) > 10


@pytest.mark.parametrize("source", ["odd", "repeated", "empty"])
def test_resampling_of_odd_input(request, source):
    docs = request.getfixturevalue(source)
    target = docs.sparkSession.createDataFrame([("one x9",), (None,)], "text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for longest, percent in ((1, 10), (2, 50), (1, 100)):
        want = _resampled(rows, ["one x9", None], longest, percent=percent)
        assert _collected(resampling.resampled(docs, target, longest=longest, percent=percent)) == want
    assert _collected(resampling.resampled(docs, target.limit(0))) == _resampled(rows, [])


def test_ranks_of_ties_and_hot_scores(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("id"), F.when(F.col("id") < 1500, 5).otherwise(F.col("id") % 4).cast("long").alias("score"))
    rows = rows.withColumn("drawable", F.col("id") % 10 > 0)
    plain = sorted(((r.score, r.id) for r in rows.filter("drawable").collect()), key=lambda r: (-r[0], r[1]))
    for count in (0, 1, 700, 1400, 2690, 2700):
        got = {(r["score"], r["id"]): r["rank"] for r in resampling.ranked(rows, count).filter("rank is not null").collect()}
        assert got == {row: place for place, row in enumerate(plain[:count], 1)}
        assert resampling.ranked(rows, count).count() == 3000
