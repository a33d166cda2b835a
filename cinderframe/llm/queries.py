"""The registered queries of this subpackage and their SQL, over the driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.llm.common import held_out
from cinderframe.llm.decontaminate import contamination
from cinderframe.llm.exact_dedup import radix_groups
from cinderframe.llm.fill_in_middle import fill_in_middle, restored
from cinderframe.llm.html_text import main_text
from cinderframe.llm.lm_scoring import lm_scores
from cinderframe.llm.minhash_tables import linked_by_tables
from cinderframe.llm.mixing import fit_domains, mixed
from cinderframe.llm.ngram_jaccard import linked_documents
from cinderframe.llm.quality_crf import fit_quality, quality_scores
from cinderframe.llm.resampling import resampled
from cinderframe.llm.sharding import shard_documents
from cinderframe.llm.suffix_dedup import without_repeats
from cinderframe.llm.token_output import token_records

#: Domains of the mix and the shares of tokens they are to have.
MIX = {"de": 0.18, "en": 0.5, "es": 0.14, "fr": 0.18}
#: The score from which a document counts as good.
GOOD = 0.7


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    encoder = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lm_scores(table(spark, folder, "documents"), held_out(F.col("id"), 7), encoder).withColumnRenamed("id", "doc_id")


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = linked_documents(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(table(spark, folder, "documents"), with_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return token_records(table(spark, folder, "documents"), tokenizer_path())


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "contaminated", F.col("items").alias("item_ids"), "overlap")


def quality_field(spark: SparkSession, folder: str, docs: DataFrame | None = None):
    docs = table(spark, folder, "documents") if docs is None else docs
    return fit_quality(docs, table(spark, folder, "labels"), ~held_out(F.col("id"), 4))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_scores(table(spark, folder, "documents"), quality_field(spark, folder))
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), 4).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return radix_groups(table(spark, folder, "documents"))


def domain_model(spark: SparkSession, folder: str, docs: DataFrame | None = None):
    """Learned from the languages of the documents that the labels table covers."""
    docs = table(spark, folder, "documents") if docs is None else docs
    covered = table(spark, folder, "labels").select("doc_id").dropDuplicates()
    labelled = docs.join(covered, "doc_id").select("doc_id", F.col("lang").alias("domain"))
    return fit_domains(docs, labelled, list(MIX))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = mixed(docs, domain_model(spark, folder), list(MIX.values()))
    shares = [F.round(F.col("member")[i], 6).alias(f"in_{name}") for i, name in enumerate(MIX)]
    return rows.select(F.col("id").alias("doc_id"), "tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle(table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_minhash_tables(spark: SparkSession, folder: str) -> DataFrame:
    found = linked_by_tables(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_ngram_jaccard, op3_suffix_dedup, op4_token_records, op5_html_text, op6_decontamination, op7_quality, op8_sharding,
        op9_exact_dedup, op10_mixing, op11_fill_in_middle, op12_minhash_tables, op13_importance_resampling,
    )
}


def _linked_sql(width: int, percent: int, more: str = "") -> str:
    """Components of documents whose shingle sets overlap enough: sets, shared shingles by pair, then what is reachable."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH RECURSIVE plain AS (
            SELECT doc_id, list_filter(string_split(regexp_replace({lower}, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i : i + {width - 1}], ' ') for i in range(1, len(w) - {width - 2})]) END AS s
            FROM plain
        ), held AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
        ), found AS (
            SELECT x, min(y) AS component_id FROM reach GROUP BY x
        )
        SELECT doc_id, len(s) AS n_shingles, component_id{more} FROM sets JOIN found ON doc_id = x
    """


ORACLES = {
    "op2_ngram_jaccard": _linked_sql(3, 90),
    "op12_minhash_tables": _linked_sql(4, 80, ", doc_id = component_id AS kept"),
    "op9_exact_dedup": r"""
        WITH plain AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        ), ranked AS (
            SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
                first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id
            FROM plain
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
    """,
    "op11_fill_in_middle": r"""
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || doc_id) AS hex FROM documents
        ), drawn AS (
            SELECT doc_id, body, length(body) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
                ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
            FROM hashed
        ), cut AS (
            SELECT doc_id, body, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90
                    THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), parts AS (
            SELECT *, substring(body, 1, a) AS prefix, substring(body, a + 1, b - a) AS middle, substring(body, b + 1) AS suffix FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
            sha256(body) AS restored_sha256
        FROM parts
    """,
}
