"""From raw puzzle documents to challenge records, without a shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.fixed_values import PART1_HEADER, PART2_HEADER, PART2_MARKER
from gradeworks.functions.documents import (
    clean_part1,
    clean_part2,
    clean_section,
    extract_answer,
    part_texts,
)
from gradeworks.functions.text import rstrip_newlines


def clean_parts(documents: DataFrame, **words: str) -> DataFrame:
    """Adds ``description``, cleaned by the rule of the row's part; null for other parts."""
    part, text = F.col("part"), F.col("text")
    cleaned = F.when(part == 1, clean_part1(text, **words)).when(
        part == 2, clean_part2(text, **words)
    )
    return documents.withColumn("description", cleaned)


def unknown_parts(documents: DataFrame) -> DataFrame:
    """Rows whose part is neither 1 nor 2."""
    return documents.where(~F.coalesce(F.col("part").isin(1, 2), F.lit(False)))


def empty_descriptions(documents: DataFrame) -> DataFrame:
    """Rows with nothing left after cleaning; kept aside, not written to the corpus."""
    return documents.where(F.coalesce(F.col("description"), F.lit("")) == "")


def split_documents(documents: DataFrame, marker: str = PART2_MARKER) -> DataFrame:
    """One row per raw part of a document: adds part, replaces text."""
    others = [c for c in documents.columns if c != "text"]
    split = documents.withColumn("parts", part_texts(F.col("text"), marker))
    parts = [
        F.struct(F.lit(n).alias("part"), F.col(f"parts.part{n}").alias("text"))
        for n in (1, 2)
    ]
    return split.select(*others, F.inline(F.array(*parts))).where("text <> ''")


def build_challenges(raw: DataFrame, marker: str = PART2_MARKER) -> DataFrame:
    """Nested challenge records from raw documents (year, day, text, input).

    Both parts come from the same document, so the record is built in its own row.
    """

    def record(name: str, header: str, keep_header: bool) -> Column:
        text = F.col(f"parts.{name}")
        part = F.struct(
            clean_section(text, header, keep_header).alias("description"),
            extract_answer(text).alias("answer"),
            F.lit(None).cast("string").alias("converted_description"),
        )
        return F.when(text != "", part).alias(name)

    return raw.withColumn("parts", part_texts(F.col("text"), marker)).select(
        "year",
        "day",
        record("part1", PART1_HEADER, True),
        record("part2", PART2_HEADER, False),
        rstrip_newlines(F.col("input")).alias("input"),
    )
