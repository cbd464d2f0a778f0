"""From raw documents to token ids, in stages; each stage's rows are written and read again.

Documents whose language is not made out go; lines that many documents share are taken out;
one document of each group of near duplicates stays; documents that hold a benchmark item go;
what is left is encoded. Every stage but the last returns the columns of its documents.

Every stage takes empty tables, extra columns of any name, null ids and columns, and texts of any
length, which it reads whole. What it does with null and empty texts, repeated rows and ties is said
with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.bpe import round_trip
from gradeworks.llm.common import short_batches
from gradeworks.llm.decontamination import without_leaks
from gradeworks.llm.language_id import accepted, fit
from gradeworks.llm.line_dedup import dedup_lines
from gradeworks.llm.simhash import one_of_each
from gradeworks.session import new_table_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LINES_IN_DOCUMENTS = 10
SHINGLE_WORDS = 4
RADIUS = 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go: no letters, or unlike all it has learned."""
    short_batches(spark)
    return accepted(docs, fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents are taken out of the texts; every document stays.

    A null text becomes an empty one. Repeated rows count as a document each, and all of them stay.
    """
    short_batches(spark)
    kept = dedup_lines(docs, LINES_IN_DOCUMENTS)
    left = {"text": kept["text"], "n_chars": F.length(kept["text"]).cast("long")}
    return kept.select(*[left.get(c, kept["doc"].getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Texts without words are alike, so one of them stays. Of repeated rows one stays, and of rows of one
    id with different texts that of the smaller hash; null ids come last.
    """
    short_batches(spark)
    return one_of_each(docs, SHINGLE_WORDS, RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, exactly or with few edits, go.

    Texts and items without words match nothing. Each row is judged by its text alone.
    """
    short_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents and the texts decoded from them, as digests.

    An empty text has no ids. Each row has its result, repeated rows too.
    """
    short_batches(spark)
    return round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# The classifier, the fingerprints and the merges have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_table_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
