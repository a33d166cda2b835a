"""From raw documents to token records: quality, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cinderframe.llm.decontaminate import without_items
from cinderframe.llm.mixing import mix_rows
from cinderframe.llm.ngram_jaccard import linked_documents
from cinderframe.llm.quality_crf import keep_good
from cinderframe.llm.queries import MIX, domain_model, quality_field, table, tokenizer_path
from cinderframe.llm.token_output import token_records
from cinderframe.session import dropped, written

#: Documents that score below are rejected.
REJECTED = 0.5
#: Words of a shingle and least Jaccard similarity in percent of near duplicates.
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go; an empty text has the score of an empty line."""
    return keep_good(docs, quality_field(spark, sf_dir, docs), REJECTED)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group; of rows that repeat an id, one. Documents without an id or words stay."""
    found = linked_documents(docs, width=SHINGLE, percent=SIMILAR)
    gone = found.filter("id <> component").select(F.col("id").alias("doc_id")).distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return left
    nth = next(n for n in (f"nth{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    first = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.rand(1))).orderBy("text")
    return left.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat until the languages have their shares of tokens; rates are at least 1, so none goes."""
    return mix_rows(docs, domain_model(spark, sf_dir, docs), list(MIX.values()), grow=True, least=1.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: No stage but the first could be told in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder, read again, and goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
