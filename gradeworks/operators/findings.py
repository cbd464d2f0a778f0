"""Lint findings of code snippets, summed per model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.fixed_values import FINDING_CATEGORIES
from gradeworks.functions.numbers import percent


def findings_summary(findings: DataFrame, snippets: DataFrame) -> DataFrame:
    """Findings by category, clean snippets, and findings per 100 code lines, by model.

    ``findings`` has (model, snippet_id, category), ``snippets`` (model, snippet_id,
    code_lines) with one row per snippet.
    """
    per_category = [
        F.count_if(F.col("category") == c).alias(c) for c in FINDING_CATEGORIES
    ]
    per_snippet = findings.groupBy("model", "snippet_id").agg(
        F.count("*").alias("found"), *per_category
    )
    joined = snippets.join(per_snippet, ["model", "snippet_id"], "left")
    totals = joined.groupBy("model").agg(
        F.count("*").alias("snippets"),
        F.count_if(F.col("found").isNull()).alias("clean_snippets"),
        F.sum("code_lines").alias("code_lines"),
        F.sum(F.coalesce("found", F.lit(0))).alias("findings"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in FINDING_CATEGORIES],
    )
    return totals.withColumn(
        "findings_per_100_lines", percent(F.col("findings"), F.col("code_lines"))
    )
