"""Writers of results, snapshots and corpus tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.sources.results import CSV_OPTIONS, EXPORT_OPTIONS

DAY_KEYS = ["model", "year", "day"]


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as parquet, partitioned by subset and k, for all later reports."""
    results.write.mode("overwrite").partitionBy("subset", "k").parquet(path)


def write_attempts(
    attempts: DataFrame, table: str, path: str, buckets: int, keys: list[str] = DAY_KEYS
) -> DataFrame:
    """Attempts, texts included, as a table in buckets by model and day; returns the table.

    All passes of both parts of a day lie in one bucket, so that selection and gating over the table need
    no shuffle. The rows are dealt to the buckets first: a bucket is one file.
    """
    dealt = attempts.repartition(buckets, *keys)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(table)
    return attempts.sparkSession.table(table)


def export_results(results: DataFrame, path: str) -> None:
    """Result rows as CSV with the row order as first column."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    others = [c for c in results.columns if c != "row_no"]
    results.select(F.col("row_no").alias("_c0"), *others).write.mode("overwrite").options(
        **options
    ).csv(path)


def write_snapshot(results: DataFrame, path: str) -> None:
    """Results so far, one folder per year: only the years in ``results`` are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "year"
    ).parquet(path)


def write_export(corpus: DataFrame, path: str) -> None:
    """A flat corpus as tab-separated text without an index column."""
    options = {k: v for k, v in EXPORT_OPTIONS.items() if k != "multiLine"}
    corpus.write.mode("overwrite").options(**options).csv(path)


def write_challenges(nested: DataFrame, path: str) -> None:
    """Nested challenge records as JSON lines, which split across tasks when read."""
    nested.write.mode("overwrite").json(path)
