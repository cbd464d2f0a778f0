"""From generated code and its runs to graded results and a report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.fixed_values import MATH, TWO_PART
from gradeworks.functions.status import status_code
from gradeworks.operators.grading import grade_math, grade_two_part, mark_timeouts
from gradeworks.operators.passes import (
    attach_texts,
    both_flat_lists,
    both_lists,
    gated_from_passes,
    pass_table,
)
from gradeworks.operators.reports import accuracy_from_codes
from gradeworks.operators.tasks import drop_final_part2
from gradeworks.schemas import PROBLEM_KEYS


def graded_attempts(executions: DataFrame, reextractions: DataFrame) -> DataFrame:
    """Two-part attempts with status and output; runs are matched by their row number."""
    return grade_two_part(mark_timeouts(executions), reextractions, ["row_no"])


def graded_problems(executions: DataFrame, reextractions: DataFrame) -> DataFrame:
    """The same for math attempts, whose integer outputs get no second look."""
    return grade_math(mark_timeouts(executions), reextractions, ["row_no"])


def two_part_results(attempts: DataFrame, k: int) -> DataFrame:
    """Best-of-k list and first-pass list of a run, as ``write_results`` takes them.

    Column ``k`` tells the lists apart; long texts are added by ``with_texts``.
    """
    return both_lists(attempts, k).withColumn("subset", F.lit(TWO_PART))


def problem_results(attempts: DataFrame, k: int) -> DataFrame:
    """The same for the math subset, whose attempts may carry ``provider_error``."""
    return both_flat_lists(attempts, k, PROBLEM_KEYS).withColumn("subset", F.lit(MATH))


def with_problem_texts(results: DataFrame, attempts: DataFrame, problems: DataFrame):
    """Math result rows as they are exported: texts of the attempt, answer and difficulty.

    ``problems`` has id, solution and difficulty. Empty texts stand for absent ones.
    """
    known = problems.select("id", F.col("solution").alias("expected_output"), "difficulty")
    rows = attach_texts(results, attempts, ["output", "stderr", "code"]).join(known, "id", "left")
    return rows.select(
        "model",
        "id",
        "status",
        F.coalesce("output", F.lit("")).alias("output"),
        "expected_output",
        F.coalesce("stderr", F.lit("")).alias("error"),
        F.coalesce("code", F.lit("")).alias("code"),
        "difficulty",
        "kpass",
        "k",
        "row_no",
    )


def with_texts(results: DataFrame, attempts: DataFrame, challenges_by_part: DataFrame):
    """Result rows as they are exported: texts of the attempt, expected answer of the task.

    A blocked part-2 row has no attempt; its texts are empty, its answer is not.
    """
    texts = ["output", "stderr", "code"]
    answers = challenges_by_part.select(
        "year", "day", "part", F.col("solution").alias("expected_output")
    )
    rows = attach_texts(results, attempts, texts).join(answers, ["year", "day", "part"], "left")
    return rows.select(
        "model",
        "year",
        "day",
        "part",
        "status",
        F.coalesce("output", F.lit("")).alias("output"),
        "expected_output",
        F.coalesce("stderr", F.lit("")).alias("error"),
        F.coalesce("code", F.lit("")).alias("code"),
        "kpass",
        "row_no",
    )


def accuracy_from_passes(passes: DataFrame, k: int) -> DataFrame:
    """Two-part accuracy per model from the passes below k of its tasks (``pass_table``)."""
    results = drop_final_part2(gated_from_passes(passes, k))
    codes = results.withColumn("code", status_code(F.col("status")))
    return accuracy_from_codes(codes, ["model"])


def best_of_k_accuracy(attempts: DataFrame, k: int) -> DataFrame:
    """Accuracy per model, overall and by part, best of k with part gating."""
    return accuracy_from_passes(pass_table(attempts.where(F.col("kpass") < k)), k)
