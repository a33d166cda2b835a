"""The llm operators against brute force, round trips, held-out labels and odd inputs."""

import random
import zlib
from collections import Counter

import brute_force
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinderframe.checks.tables import normal_rows, oracle_rows
from cinderframe.llm import decontaminate, exact_dedup, html_text, lm_scoring, mixing, ngram_jaccard, quality_crf, queries, sharding, suffix_dedup, token_output
from cinderframe.llm.common import held_out

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, keep_id string, row int, id double, found boolean"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "a b c d e f g h " * 3000), (8, "ab" * 4000), (9, "né É ß x"), (10, "one two")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties; extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, 0.5, True) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(odd):
    """Repeated rows and a null id."""
    return odd.unionByName(odd.filter("doc_id in (4, 7)")).unionByName(odd.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def _texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def _passages(seed):
    random.seed(seed)
    draw = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    shared = [draw(random.randint(60, 400)) for _ in range(6)] + ["ab" * 150, "x" * 230, draw(17) * 14]
    rows = []
    for i in range(80):
        text = ""
        for _ in range(random.randint(0, 5)):
            p = random.choice(shared)
            at = random.randint(0, len(p) // 2)
            text += draw(random.randint(0, 150)) + p[at : random.randint(at, len(p))]
        rows.append((i, random.choice(rows)[1] if rows and random.random() < 0.2 else text))
    return rows


# 1: language model


def _base(rows):
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    base = {i: sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws) for i, ws in words.items()}
    return held, base, {i: sum(counts[w] > 0 for w in ws) for i, ws in words.items()}, total


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_lm_counts(request, source):
    docs = request.getfixturevalue(source)
    held, base, known, total = _base(_texts(docs))
    encoder = (queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN)
    rows = lm_scoring.lm_scores(docs, held_out(F.col("id"), 7), encoder).collect()
    assert {r.id: r.n_known for r in rows} == known
    assert all(r.train_tokens == total and r.held_out == held[r.id] and abs(r.base_score - base[r.id]) < 1e-6 * max(1, abs(base[r.id])) for r in rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_lm_empty_table(empty):
    encoder = (queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN)
    assert lm_scoring.lm_scores(empty, held_out(F.col("id"), 7), encoder).count() == 0


def test_subwords_behind_a_very_long_word():
    encoder = (queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN)
    words = [b"one", b"x1" * 200_000, b"two", b"three"]
    known = lm_scoring._subwords(*encoder)[0]
    flat, lengths = lm_scoring.word_subwords(words, encoder)
    assert lengths[1] > 1 << 16 and lengths.sum() == len(flat)
    ids, sizes = lm_scoring._sequences(np.array([0, 1, 2, 3, 0], np.uint32), np.array([2, 3], np.uint32), lengths, flat, 50256)
    want = known.encode_ordinary(" two three one")
    assert ids[sizes[0] :].tolist() == [*want, 50256] and len(ids) == sizes.sum()


def test_training_rounds_use_every_window_once(monkeypatch):
    from cinderframe.llm import attention as A

    seen, look = [], A._seen
    monkeypatch.setattr(A, "_seen", lambda classes, start, low, high: (seen.extend(start), look(classes, start, low, high))[1])
    inputs = np.arange(100_000) % A.OUTPUTS
    lengths = np.full(100, 1000)
    model = A.fresh(np.zeros((A.BEFORE, A.INPUTS, A.OUTPUTS)))
    used = [A.train(model, inputs, inputs, lengths, part, lm_scoring.ROUNDS, 3) for part in range(lm_scoring.ROUNDS)]
    start = A.windows(lengths)[0]
    assert sorted(seen) == sorted(start) and sum(used) == len(start)


def test_attention_probabilities_are_causal_and_sum_to_one():
    from cinderframe.llm import attention as A

    model = A.fresh(np.zeros((A.BEFORE, A.INPUTS, A.OUTPUTS)))
    draw = np.random.default_rng(0)
    inputs = draw.integers(0, A.INPUTS, 50)
    total = np.zeros(50)
    for target in range(A.OUTPUTS):
        total += np.exp(A.log_probabilities(model, inputs, np.full(50, target), np.array([20, 30])))
    assert np.allclose(total, 1, atol=1e-4)
    targets = draw.integers(0, A.OUTPUTS, 50)
    before = A.log_probabilities(model, inputs, targets, np.array([20, 30]))
    changed = inputs.copy()
    changed[30:] = 3
    after = A.log_probabilities(model, changed, targets, np.array([20, 30]))
    assert np.allclose(before[:30], after[:30]) and not np.allclose(before[30:], after[30:])


def test_attention_tells_all_subwords_apart():
    from cinderframe.llm import attention as A

    classes = lm_scoring.Classes(np.random.default_rng(1).integers(0, 9, 50257).astype(float), 50256)
    for codes in (classes.input, classes.output):
        assert len(np.unique(codes)) == 50257
    counts = np.random.default_rng(2).integers(0, 3, (A.INPUTS, lm_scoring.NAMED + 1))
    model = A.fresh(np.zeros((A.BEFORE, A.INPUTS, A.OUTPUTS)), classes.rest(counts))
    every = np.append(np.arange(A.OUTPUTS - 1), A.OUTPUTS + np.arange(A.BASE**A.LEVELS))
    for code in (3, A.PAD + 1 + 40_000):
        found = A.log_probabilities(model, np.full(len(every), code), every, np.ones(len(every), int))
        assert abs(np.exp(found.astype(float)).sum() - 1) < 1e-3
    # which rare subword came before changes what each class, and each rare subword, is expected to be
    one, other = (np.array([A.PAD + 1 + number, 3, 4]) for number in (30_000, 30_001))
    for target in (5, A.OUTPUTS + 20_000):
        a, b = (A.log_probabilities(model, codes, np.full(3, target), np.array([3])) for codes in (one, other))
        assert (np.abs(a - b) > 1e-7).all()


def test_attention_learns_a_rare_subword_from_a_rare_one():
    from cinderframe.llm import attention as A

    pair = np.random.default_rng(3).integers(0, 2, 20_000)
    inputs = np.stack([A.PAD + 1 + 900 * pair, np.full(20_000, 7)], 1).ravel()
    targets = np.stack([np.full(20_000, 7), A.OUTPUTS + 5_000 + 50 * pair], 1).ravel()
    lengths = np.full(20_000, 2)
    model = A.fresh(np.zeros((A.BEFORE, A.INPUTS, A.OUTPUTS)))
    A.train(model, inputs, targets, lengths, 0, 1, 3)
    assert A.log_probabilities(model, inputs, targets, lengths)[1::2].mean() > -0.2


# 2: near duplicates


def test_links_match_brute_force(documents, odd):
    for docs in (documents, odd):
        want = brute_force.linked_documents(_texts(docs))
        assert {r.id: (r.n_shingles, r.component) for r in ngram_jaccard.linked_documents(docs).collect()} == want


def test_links_of_near_copies_with_edits(spark):
    random.seed(5)
    base = [[f"w{random.randint(0, 500)}" for _ in range(n)] for n in (60, 200, 400)]
    rows = []
    for i in range(150):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = f"x{random.randint(0, 50)}"
        rows.append((i, " ".join(words)))
    for width, percent in ((3, 90), (5, 80)):
        got = ngram_jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent)
        assert {r.id: (r.n_shingles, r.component) for r in got.collect()} == brute_force.linked_documents(rows, width, percent)


def test_parities_never_differ_in_more_bits_than_sets_do():
    draw = np.random.default_rng(3)
    for n in (1, 30, 400, 3000):
        shared, mine, theirs = (np.unique(draw.integers(1, 1 << 63, k, np.uint64)) for k in (n, n // 10 + 1, n // 7 + 1))
        left, right = (ngram_jaccard._parities(np.union1d(shared, own)) for own in (mine, theirs))
        bits = sum(int(x).bit_count() for x in (left ^ right).view(np.uint64))
        assert 0 < bits <= len(np.setxor1d(mine, theirs))
        assert not (left ^ ngram_jaccard._parities(np.union1d(mine, shared))).any()


def test_links_of_repeated_rows_and_nulls(repeated, empty):
    rows = ngram_jaccard.linked_documents(repeated).collect()
    assert len(rows) == len(ODD) + 3
    assert {r.component for r in rows if r.id is None} == {None}
    assert ngram_jaccard.linked_documents(empty).count() == 0


# 3: repeated passages


def test_repeats_match_brute_force(spark, documents, odd):
    passages = spark.createDataFrame(_passages(3), "doc_id long, text string").repartition(5)
    for docs, meet in ((passages, 2000), (passages, 1), (documents, 2000), (odd, 2000)):
        got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs, meet=meet).collect()}
        assert got == brute_force.without_repeats(_texts(docs))


def test_repeats_of_repeated_rows(repeated, empty):
    rows = suffix_dedup.without_repeats(repeated).collect()
    assert len(rows) == len(ODD) + 3
    long = sorted((r.n_removed for r in rows if r.n_bytes == 48000), reverse=True)
    assert long[0] == long[1] == 48000 > long[2]  # the first of three equal texts keeps its beginning
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_suffix_order_sorts_and_verifies():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 100, 4000).astype(np.uint8)
    places = draw.permutation(3900)[:500]
    block = np.sort(draw.integers(0, 5, 500))
    order, equal = suffix_dedup.suffix_order(suffix_dedup.PrefixHashes(data), data, places, block, 12)
    text = [bytes(data[p : p + 12]) for p in places]
    want = sorted(range(500), key=lambda i: (block[i], text[i], i))
    assert order.tolist() == want
    assert equal.tolist() == [k > 0 and block[want[k]] == block[want[k - 1]] and text[want[k]] == text[want[k - 1]] for k in range(500)]


# 4: token records


def test_token_records(spark, odd, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    special = spark.createDataFrame([(-(2**63), "hi <|endoftext|> there"), (2, "<|endoftext|>"), (3, "x<|endoftext|>  <|endoftext|>y "), (4, "a <|endoftext> b\n")], "doc_id long, text string")
    assert 50256 in whole.encode("hi <|endoftext|> there", add_special_tokens=False).ids
    for docs in (odd, documents, special):
        start = 0
        got = {r.doc_id: r for r in token_output.token_records(docs, queries.tokenizer_path()).collect()}
        for key, text in sorted(_texts(docs)):
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_token_files(spark, tmp_path, repeated, empty):
    folder = f"file://{tmp_path}"
    manifest = token_output.write_records(repeated, folder, queries.tokenizer_path(), file_bytes=20_000).collect()
    assert sum(r.n_docs for r in manifest) == len(ODD) + 3
    for r in manifest:
        index = np.fromfile(r["index"], token_output.INDEX)
        for entry in index:
            key, ids = token_output.read_at(folder, r.file, int(entry["offset"]))
            assert key == (None if entry["null_id"] else entry["doc_id"]) and len(ids) == entry["n_tokens"]
        broken = bytearray(open(r.file, "rb").read())
        broken[15] ^= 1
        with pytest.raises(ValueError):
            list(token_output.frames(bytes(broken)))
    assert token_output.token_records(empty, queries.tokenizer_path()).count() == 0


def test_encoder_cuts_like_the_library():
    known = token_output.encoder(queries.tokenizer_path())
    texts = ["", " ", "a  b", "a \n b", "\n\n x", "don't  stop 12 a1!!   b", "x  y <|endoftext|> z", "tail "]
    want = [e.ids for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # with words remembered, too, and one by one
        assert [x.tolist() for x in known.encode(texts)] == want
    assert [known.encode([t])[0].tolist() for t in texts] == want


def test_pieces_of_texts_encode_like_the_library(monkeypatch):
    known = token_output.Encoder(queries.tokenizer_path())
    parts = [
        *"aBzéßœȳʒжΩ中१०²½_'\"-.,$#!?()<|>09", " ", " ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x7f", "\x00", "\x85", "\xa0", "\u1680", "\u2003", "\u2019",
        "\u3000", "\u0301", "'s", "'re", "word", " word", "Straße", "×", "÷", "<|endoftext|>", "x" * 30, "\U0001f600",
    ]
    rng = random.Random(11)
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(6000)]
    want = [e.ids for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in known.encode(texts)] == want
    monkeypatch.setattr(token_output, "REMEMBERED", 20_000)  # what is remembered goes again and again
    for _ in range(2):
        assert [x.tolist() for i in range(0, 6000, 700) for x in known.encode(texts[i : i + 700])] == want


def test_words_that_differ_in_their_tails_reach_the_library_once(monkeypatch):
    known, seen = token_output.Encoder(queries.tokenizer_path()), []
    library = known._library
    monkeypatch.setattr(known, "_library", lambda texts: (seen.extend(texts), library(texts))[1])
    known.encode([" ".join(f"{word}{tail}" for word in ("alpha", "beta") * 50 for tail in ("", ",", ".", "!", "$$$"))])
    assert sum(map(len, seen)) < 40


def test_a_shared_hash_of_pieces_does_no_harm(monkeypatch):
    monkeypatch.setattr(token_output, "STEPS", np.zeros(3, np.uint64))
    known, texts = token_output.Encoder(queries.tokenizer_path()), ["one two six", "two one ten"]
    assert [x.tolist() for x in known.encode(texts)] == [e.ids for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]


# 5: pages


def test_page_blocks_and_host_boilerplate(spark):
    page = "<html><head><title>t</title></head><body>%s<article><h1>A &amp; B</h1><p>one\n two<p>three<aside>x</aside><div class='comments'>c</div></article>%s<footer>f</footer>"
    frame = "<div>subscribe to our letter and get the best of all</div>"
    rows = [(i, "http://h/a", page % (frame, f"<div>just{i} this{i}</div>"), "x") for i in range(3)]
    rows += [(9, None, None, "x"), (10, "http://h/b", "", "x"), (11, "http://h/c", "<p>alone &lt;3</p><script>if (a<b) x()</script>", "x"), (11, "http://h/c", "<p>alone &lt;3</p>", "x")]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in found.collect()), key=str)
    body = "A & B\none two\nthree\njust%d this%d"
    want = [(i, body % (i, i), len(body % (i, i))) for i in range(3)] + [(9, "", 0), (10, "", 0), (11, "alone <3", 8), (11, "alone <3", 8)]
    assert got == sorted(want, key=str)
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_notices_inside_articles_go_and_copied_articles_stay(spark):
    notice = "please share this story with all of your friends today"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    page = "<body><article><p>%s</p><p>%s</p><p>%s</p></article></body>"
    rows = [(i, "http://h/a", page % (own(i), notice, own(-i - 1))) for i in range(8)]
    shared = " ".join(f"s{k}" for k in range(40))
    rows += [(20 + i, "http://h/b", page % (shared, own(20 + i)[:20], "end")) for i in range(6)]  # near copies
    rows += [(30 + i, "http://h/c", page % (own(30), notice, own(31))) for i in range(3)]  # equal pages
    rows += [(40 + i, "http://few/a", page % (own(40 + i), notice, "end")) for i in range(3)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"{own(i)}\n{own(-i - 1)}" for i in range(8))
    assert all(found[20 + i] == f"{shared}\n{own(20 + i)[:20].strip()}\nend" for i in range(6))
    assert all(found[30 + i] == f"{own(30)}\n{own(31)}" for i in range(3))
    assert all(notice in found[40 + i] for i in range(3))  # three pages are not many


def test_repeats_in_many_chunks_are_counted_as_in_one(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").withColumn("url", F.lit("http://one/"))
    want = sorted((r.page_id, r.text) for r in html_text.main_text(pages).collect())
    monkeypatch.setattr(html_text, "CHUNK_WORDS", 3000)
    assert sorted((r.page_id, r.text) for r in html_text.main_text(pages).collect()) == want


def test_blocks_of_pages_move_once(spark):
    """Steps behind the dealing read its buckets: only what is counted goes through an exchange; and no table stays in the catalog."""
    before = spark.catalog.listTables()
    pages = spark.createDataFrame([(i, "http://h/", f"<p>some words of page {i}") for i in range(9)], "page_id long, url string, html string")
    found = html_text.main_text(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not any("body" in line for line in plan.splitlines() if "Exchange hash" in line)
    scan = next(line for line in plan.splitlines() if "Bucketed: true" in line and "body" in line)
    above = plan.splitlines()[: plan.splitlines().index(scan)][-3:]
    assert not any("Exchange" in line for line in above)
    assert found.count() == 9 and spark.catalog.listTables() == before


def test_suffix_ranks():
    tokens = np.random.default_rng(1).integers(0, 3, 300)
    rank = html_text.suffix_ranks(tokens, 5)
    text = [tuple(tokens[i : i + 5]) for i in range(300)]
    assert all((rank[i] < rank[j]) == (text[i] < text[j]) for i in range(0, 300, 7) for j in range(300))


# 6: decontamination


def test_contamination_matches_brute_force(spark, documents):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    sets = {r.item_id: decontaminate.shingles_of(decontaminate.words_of(r.text)) for r in items.collect()}
    want = {}
    for key, text in _texts(documents):
        held = decontaminate.shingles_of(decontaminate.words_of(text))
        want[key] = sorted(i for i, s in sets.items() if len(s & held) >= 0.8 * len(s))
    got = {r.id: r.items for r in decontaminate.contamination(documents, items).collect()}
    assert got == want and any(want.values())


def test_contamination_by_edited_items_and_odd_input(spark, odd, repeated, empty):
    item = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    words = item.split()
    docs = [(20, "x y z " + item.upper() + " more"), (21, " ".join(words[:38]) + " end"), (22, " ".join(words[:25]))]
    got = {r.id: r.items for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {20: [1], 21: [1], 22: []}
    for docs in (odd, repeated, empty):
        assert decontaminate.contamination(docs, items).filter("contaminated").count() == 0
        assert decontaminate.without_items(docs, items).count() == docs.count()
    assert decontaminate.contamination(odd, items.limit(0)).count() == len(ODD)


def test_contamination_by_items_without_id_or_of_other_types(spark):
    one, two = "the quick brown fox jumps over the lazy dog again", "five boxing wizards jump quickly past seven tall trees"
    docs = spark.createDataFrame([(1, f"{one} and {two}"), (2, one), (3, "nothing at all")], "doc_id long, text string")
    for kind, ids, want in (("long", (None, 7), [7, None]), ("short", (3, 7), [3, 7]), ("string", ("b", None), ["b", None]), ("double", (1.5, 2.5), ["1.5", "2.5"])):
        items = spark.createDataFrame(list(zip(ids, (one, two))), f"item_id {kind}, text string")
        found = {r.id: (r.contaminated, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
        assert found == {1: (True, want), 2: (True, [ids[0] if kind in ("long", "short") else None if ids[0] is None else str(ids[0])]), 3: (False, [])}


# 7: quality


def test_quality_on_held_out_labels(spark):
    rows = queries.op7_quality(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    labelled = rows.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    assert len(labelled) > 50 and (labelled.predicted == labelled.quality).mean() > 0.95


def test_line_marginals_match_enumeration():
    field = quality_crf.LineField(np.random.default_rng(3).normal(size=quality_crf.N_FEATURES), np.array([[0.3, -0.2], [-0.4, 0.6]]))
    texts = [b"Abc def.\n!! | 12\n\nxx yy", b"", b"one line"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    features, first, length = quality_crf.line_features(data, np.cumsum([0, *map(len, texts)]))
    assert np.diff(first).tolist() == [4, 1, 1] and length.tolist() == [8, 7, 0, 5, 0, 8]
    good, _, log_z = quality_crf.marginals(field, features, first)
    for d in range(3):
        score = features[first[d] : first[d + 1]] @ field.emit
        total, each = 0.0, np.zeros(len(score))
        for code in range(2 ** len(score)):
            labels = np.array([(code >> k) & 1 for k in range(len(score))])
            weight = np.exp((score * labels).sum() + sum(field.move[a, b] for a, b in zip(labels[:-1], labels[1:])))
            total += weight
            each += weight * labels
        assert np.allclose(good[first[d] : first[d + 1]], each / total) and np.isclose(log_z[d], np.log(total))


def test_quality_of_odd_input(spark, odd, repeated, empty):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd, repeated, empty):
        field = quality_crf.fit_quality(docs, labels, F.lit(True))
        rows = quality_crf.quality_scores(docs, field).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality_crf.keep_good(docs, field, 0.0).count() == docs.count()


def test_long_or_repeated_rows_displace_no_quality_sample(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(quality_crf, "train", lambda texts, labels: learned.append((texts, labels)))
    rows = [(i, f"text {i}") for i in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    by_hash = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    first, second = by_hash[:2]
    docs = [(i, "x" * 9_000_000 if i == first else t) for i, t in rows] + [(second, "y" * 900_000)] * 12
    quality_crf.fit_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True))
    assert sorted(learned[0][0]) == sorted(t for i, t in rows if i != first) and set(learned[0][1]) == {0, 1}
    docs = [(i, "x" * 2_000_000 if i % 2 else t) for i, t in rows[:6]]
    with pytest.raises(ValueError, match="labelled"):
        quality_crf.fit_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True))


# 8: shards


def test_shards_have_near_equal_bytes_and_gapless_slots(spark, odd, repeated, empty):
    hot = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(3000)], "doc_id long, text string")
    for docs, shards in ((hot, 40), (odd, 3), (repeated, 3), (empty, 3)):
        rows = pd.DataFrame([r.asDict() for r in sharding.shard_documents(docs, shards).collect()])
        assert len(rows) == docs.count()
        if not len(rows):
            continue
        largest, mean = rows["size"].max(), rows["size"].sum() / shards
        assert all(abs(b - mean) <= 2 * largest for b in rows.groupby("shard")["size"].sum())
        assert rows.shard.between(0, shards - 1).all()
        assert all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard").slot)
    texts = dict((i, t) for i, t in ODD)
    for r in sharding.shard_documents(odd, 3).collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "bytes")


# 9: exact duplicates


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_exact_groups_match_sql(spark, folder):
    df = queries.op9_exact_dedup(spark, folder)
    assert normal_rows(df.columns, df.collect()) == normal_rows(*oracle_rows(folder, queries.ORACLES["op9_exact_dedup"]))


def test_exact_groups_of_odd_input(repeated, empty):
    rows = exact_dedup.radix_groups(repeated, digit=4).collect()
    assert len(rows) == len(ODD) + 3
    by = {r.doc_id: r for r in rows}
    assert by[1].group_size == 3 and by[3].kept and not by[1].kept  # the longest original of the empty ones stays
    assert by[5].group_size == 2 and by[10].keep_id == 5 and by[6].group_size == 1
    assert by[7].group_size == 3 and by[7].keep_id is None and by[None].kept
    assert exact_dedup.radix_groups(empty).count() == 0


# 10: mixing


def test_mixing_reaches_targets(spark):
    rows = queries.op10_mixing(spark, "/root/testdata/sf0.01").toPandas()
    total = (rows.rate * rows.tokens).sum()
    for name, share in queries.MIX.items():
        assert abs((rows[f"in_{name}"] * rows.rate * rows.tokens).sum() / total - share) < 0.005
    assert (rows.rate >= 0).all() and ((rows.copies - rows.rate).abs() < 1).all()


@pytest.mark.parametrize("targets, grow, least", [([0.2, 0.5, 0.3], False, 0.0), ([0.2, 0.5, 0.3], True, 1.0), ([0.0, 0.6, 0.4], False, 0.0)])
def test_mix_of_a_rare_domain_reaches_targets(spark, targets, grow, least):
    rows = [(100, [0.998, 0.001, 0.001])] * 960 + [(100, [0.002, 0.996, 0.002])] * 30 + [(100, [0.001, 0.001, 0.998])] * 10
    members = spark.createDataFrame(rows, "tokens long, member array<double>")
    steps, reached, wanted = mixing.fit_steps(members, targets, grow, least)
    total = sum(wanted)
    limit = mixing.CLOSE * total if targets[0] else 0.005 * total  # a domain that all documents hold a little of cannot be 0
    assert len(steps) < 40 and max(abs(r - w) for r, w in zip(reached, wanted)) <= limit


def test_unreachable_mix_is_told(spark):
    docs = spark.createDataFrame([(i, f"one two {i}") for i in range(20)], "doc_id long, text string")
    model = mixing.DomainModel(["a", "b"], np.zeros((mixing.BUCKETS, 2), np.float32), np.array([0.5, -0.5], np.float32))
    with pytest.warns(UserWarning, match="missed"):
        mixing.mixed(docs, model, [0.1, 0.9])


def test_domains_learn_from_whole_texts(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(mixing, "train_on", lambda seen, labels, domains: learned.append((np.array(seen), labels)))
    long = "junk " * 2000 + "völlig anders " * 200_000
    docs = spark.createDataFrame([(1, long), (2, "b a"), (2, "a b"), (2, ""), (3, None)], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "de"), (2, "en"), (3, "en")], "doc_id long, domain string")
    for rows in (docs, docs.orderBy(F.desc("text"))):
        mixing.fit_domains(rows, labelled, ["de", "en"])
    data = np.frombuffer(long.encode(), np.uint8)
    assert np.allclose(learned[0][0][0], np.bincount(mixing._pairs(data), minlength=mixing.BUCKETS) / len(data))
    assert learned[0][1] == [0, 1] and (learned[0][0] == learned[1][0]).all()


def test_domains_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").toPandas()
    names = list(queries.MIX)
    model = mixing.train(docs.text[:500].tolist(), [names.index(x) for x in docs.lang[:500]], names)
    data = [t.encode() for t in docs.text[500:]]
    member, words = mixing.posteriors(model, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert np.allclose(member.sum(1), 1) and words.tolist() == [len(t.split()) for t in data]
    assert (member.argmax(1) == [names.index(x) for x in docs.lang[500:]]).mean() > 0.95


def test_mixing_of_odd_input(odd, repeated, empty):
    model = mixing.DomainModel(["a", "b"], np.zeros((mixing.BUCKETS, 2), np.float32), np.array([0.5, -0.5], np.float32))
    for docs in (odd, repeated, empty):
        assert mixing.mixed(docs, model, [0.3, 0.7]).count() == docs.count()
        out = mixing.mix_rows(docs, model, [0.3, 0.7], grow=True, least=1.0)
        assert out.columns == docs.columns and out.count() >= docs.count()


# the pipeline


def test_pipeline_stages(spark, documents):
    docs, before = documents, None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "token_output":
            assert docs.columns == documents.columns
        if name == "near_duplicates":
            want = brute_force.linked_documents(_texts(before), corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert docs.count() == before.count() and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_stages_on_odd_documents(spark, repeated):
    docs = repeated.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test-odd")
    assert docs.columns[:2] == ["doc_id", "text"]
    corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()


def test_near_duplicates_leave_no_large_tables(spark):
    """Sets, prefixes, lists and texts go as soon as no later step reads them, and the result can still be computed, twice."""
    import os

    from cinderframe.session import dropped, shared_folder, written

    root = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root))
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [t + " more" for t in texts[:10]])], "doc_id long, text string")
    found = ngram_jaccard.linked_documents(docs)
    want = {i: i - 30 if i >= 30 else i for i in range(40)}
    for _ in range(2):
        assert {r.id: r.component for r in found.collect()} == want
    left = {name.rpartition("-")[0] for name in set(os.listdir(root)) - before}
    assert left <= {"jaccard-classes", "jaccard-sizes", "components"}, left
    kept, gone = written(docs, "kept"), written(docs, "gone")
    dropped(spark, gone, docs)
    names = {name.rpartition("-")[0] for name in set(os.listdir(root)) - before}
    assert "kept" in names and "gone" not in names and kept.count() == docs.count() == 40
