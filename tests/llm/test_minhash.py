"""Tensored minhash tables against brute force, hot groups and odd inputs."""

import random

import brute_force
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderframe.checks.tables import normal_rows, oracle_rows
from cinderframe.llm import minhash_tables as mt, ngram_jaccard as nj, queries
from cinderframe.llm.quality_crf import N_FEATURES, LineField, keep_good

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, class int, root string, key double, a long, n string"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One\vTWO"), (7, "a b c d e f g h " * 3000), (8, "ab" * 4000), (9, "né É ß x"),
    (10, "né é ß x"), (-11, "a b c d e f g h " * 2000), (12, "one"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties; extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, "r", 0.5, 2, "n") for i, t in ODD], SCHEMA)


def _found(docs, **given):
    return {r.id: (r.n_shingles, r.component) for r in mt.linked_by_tables(docs, **given).collect()}


def _near_copies(seed, groups, copies, words=60):
    """Copies with a few words changed, some of them around the limit of similarity; and a passage that all documents share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, rows = [word() for _ in range(25)], []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(words)] = word()
            rows.append((len(rows), " ".join(passage + text)))
    return rows


def test_linked_query_matches_sql(spark):
    for name in ("op12_minhash_tables", "op2_ngram_jaccard"):
        df = queries.QUERIES[name](spark, FOLDER)
        assert normal_rows(df.columns, df.collect()) == normal_rows(*oracle_rows(FOLDER, queries.ORACLES[name]))


def test_links_around_the_limit(spark):
    rows = _near_copies(1, 40, 12)
    got = _found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == brute_force.linked_documents(rows, 4, 80)


def test_links_of_other_widths(spark, odd):
    rows = _near_copies(3, 20, 6)
    got = _found(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=70)
    assert got == brute_force.linked_documents(rows, 5, 70)
    assert _found(odd) == brute_force.linked_documents(ODD, 4, 80)


def test_a_hot_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """A group of k near copies costs about k pairs, not k * k; all of them are found."""
    rng, seen = random.Random(4), []
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(700):
        text = list(base)
        text[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(text)))
    verified = mt._verified

    def counting(pairs, *given):
        pairs = pairs.cache()
        seen.append(pairs.count())
        return verified(pairs, *given)

    monkeypatch.setattr(mt, "_verified", counting)
    monkeypatch.setattr(mt, "TOGETHER", 64)
    got = _found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_force.linked_documents(rows, 4, 80)
    assert sum(seen) < 20 * len(rows)


def test_repeated_ids_are_one_document(spark, odd):
    near = "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 "
    rows = [(5, "a b c d e f g h i j"), (5, near + "k l m"), (7, "a b c d e f g h i j"), (8, near + "k l n"), (9, "far away from all of them"), (None, near + "k l m"), (None, None)]
    found = mt.linked_by_tables(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.component, r.kept) for r in found if r.id is not None) == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]
    assert [(r.component, r.kept) for r in found if r.id is None] == [(None, True)] * 2
    repeated = odd.unionByName(odd.filter("doc_id in (4, 7)")).unionByName(odd.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    found = mt.linked_by_tables(repeated).collect()
    want = brute_force.linked_documents(ODD, 4, 80)
    assert len(found) == len(ODD) + 3 and all((r.n_shingles, r.component) == want[r.id] for r in found if r.id is not None)


def test_empty_tables(spark, odd):
    assert mt.linked_by_tables(odd.limit(0)).collect() == []
    assert mt.linked_by_tables(odd.filter("doc_id < 4 and doc_id > 0")).count() == 3


def test_share_of_equal_minhashes_estimates_similarity():
    rng = np.random.default_rng(5)
    for same in (300, 800, 950):
        shared = rng.integers(0, 1 << 63, same, np.uint64)
        sets = [np.concatenate([shared, rng.integers(0, 1 << 63, 1000 - same, np.uint64)]) for _ in range(2)]
        least = mt.minhashes(np.concatenate(sets), np.array([0, 1000, 2000]), 4000)
        assert abs((least[:, 0] == least[:, 1]).mean() - same / (2000 - same)) < 0.03


def test_tables_are_pairs_of_codes_of_two_collections():
    rng = np.random.default_rng(6)
    least = rng.integers(0, 1 << 63, (2 * 5 * 3, 4), np.uint64)
    least[:3, 1] = least[:3, 0]  # the first code of the first collection agrees
    left, right = mt.collections(least, 5, 3)
    assert left[0, 0] == left[0, 1] and len(np.unique(np.concatenate([left, right]))) == 2 * 5 * 4 - 1


def _exchanges(spark, texts, key):
    """Exchanges of a join of the texts with some of their keys, all of it without a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = texts.join(spark.range(5).withColumnRenamed("id", key), key)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return plan.count("Exchange ")


@pytest.mark.parametrize(("module", "find", "key"), [(mt, mt.linked_by_tables, "row"), (nj, nj.linked_documents, "id")])
def test_keys_meet_texts_where_they_lie(spark, odd, monkeypatch, module, find, key):
    seen, real = [], module._verified
    monkeypatch.setattr(module, "_verified", lambda pairs, texts, *a: seen.append(texts) or real(pairs, texts, *a))
    find(odd.filter("doc_id between 4 and 8"))
    assert _exchanges(spark, seen[0], key) == 1


def test_python_gets_texts_in_small_batches(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    keep_good(docs, LineField(np.zeros(N_FEATURES), np.zeros((2, 2))), 0.0)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["doc_id"])

    largest = docs.mapInArrow(sizes, "doc_id long").agg(F.max("doc_id")).first()[0]
    assert largest < 5 << 20
