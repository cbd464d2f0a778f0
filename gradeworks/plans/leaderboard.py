"""From a table of all result rows to the leaderboards."""

from pyspark.sql import DataFrame

from gradeworks.operators.reports import (
    accuracy_cube,
    error_buckets,
    error_percentages,
    error_shares,
    leaderboard,
    overall_score,
    with_subset_label,
)
from gradeworks.sources.results import report_files


def leaderboards(results: DataFrame, path_column: str = "path") -> dict[str, DataFrame]:
    """Accuracy cube, model table and ranking over the rows of all results files."""
    cube = accuracy_cube(results, path_column)
    return {"cube": cube, "models": leaderboard(cube), "ranking": overall_score(cube)}


def error_report(results: DataFrame, path_column: str = "path") -> DataFrame:
    """Error shares per model and subset in percent, with shade indices and labels.

    All files are summed up in one pass; which of them belong in the report is told from
    their paths, one row per file.
    """
    shares = report_files(error_shares(results, [path_column]), path_column)
    percentages = error_percentages(shares, ["model", "subset"])
    return with_subset_label(error_buckets(percentages))
