"""Grading of runs and answers against the expected solution.

Inputs: ``executions`` (keys, stdout, stderr, solution, …) and ``reextractions`` (keys,
text). Both are unique on the keys; ``second_look_faults`` names the keys that are not.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.fixed_values import (
    PROVIDER_ERROR_PREFIX,
    STATUSES,
    TIME_LIMIT_SECONDS,
    TIMEOUT_MARK,
)
from gradeworks.functions.grading import (
    answer_needs_second_look,
    direct_answer,
    grade_answer,
    grade_run,
    needs_second_look,
    printed_text,
)
from gradeworks.functions.text import extract_code, python_strip
from gradeworks.operators.hotkeys import join_sparse_values
from gradeworks.operators.tasks import key_violations


def with_effective_code(generations: DataFrame) -> DataFrame:
    """Adds ``code``: the response if it parses, else its fenced code, else the response.

    ``valid`` says whether a response parses; the parser is not part of this package. Null counts as no.
    """
    snippet = extract_code(F.col("response"))
    return generations.withColumn(
        "code",
        F.when(F.col("valid"), F.col("response"))
        .when(snippet != "", snippet)
        .otherwise(F.col("response")),
    )


def syntax_rates(generations: DataFrame, by: list[str]) -> DataFrame:
    """Responses per group, and those of them that parse (``valid``); no response is read."""
    return generations.groupBy(*by).agg(
        F.count("*").alias("responses"), F.count_if("valid").alias("valid")
    )


def mark_timeouts(executions: DataFrame, limit: float = TIME_LIMIT_SECONDS) -> DataFrame:
    """Runs over the limit lose their output and get the timeout marker as error."""
    late = F.col("duration_s") > limit
    return executions.withColumns(
        {
            "stdout": F.when(late, "").otherwise(F.col("stdout")),
            "stderr": F.when(late, TIMEOUT_MARK).otherwise(F.col("stderr")),
        }
    )


def ignore_warnings(executions: DataFrame) -> DataFrame:
    """Runs that ended with exit code 0 lose their error text, so warnings do not count.

    An option: by default any error text is a failure.
    """
    ended_well = F.coalesce(F.col("exit_code") == 0, F.lit(False))
    return executions.withColumn(
        "stderr", F.when(ended_well, "").otherwise(F.col("stderr"))
    )


def _with_second_text(rows: DataFrame, reextractions: DataFrame, keys) -> DataFrame:
    """Adds ``second_text`` to rows whose verdict is open (``is_open``).

    The rows are read once. The condition on the verdict is part of the join, so that what was worked
    out for it in front of the join is not worked out again behind it.
    """
    texts = reextractions.select(*[F.col(k).alias(f"{k}_text") for k in keys], F.col("text").alias("second_text"))
    same = [F.col(k) == F.col(f"{k}_text") for k in keys]
    joined = rows.join(texts, [*same, F.col("is_open")], "left")
    return joined.drop(*[f"{k}_text" for k in keys])


def second_look_faults(reextractions: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one re-extracted answer, and how many: their rows would be graded that often."""
    return key_violations(reextractions, keys)


def with_printed(executions: DataFrame, integer_guard: bool = False) -> DataFrame:
    """Adds ``printed``, the stripped output, and ``is_open``: whether the verdict waits for a second look."""
    printed = executions.withColumn("printed", printed_text(F.col("stdout")))
    needed = needs_second_look(F.col("printed"), F.col("stderr"), F.col("solution"), integer_guard)
    return printed.withColumn("is_open", needed)


def with_grade(runs: DataFrame) -> DataFrame:
    """Adds status and output to runs that carry ``printed``, ``is_open`` and ``second_text``."""
    names = ["stdout", "printed", "stderr", "solution", "is_open", "second_text"]
    grade = grade_run(*[F.col(n) for n in names])
    graded = runs.withColumns({"status": grade.status, "output": grade.output})
    return graded.drop("printed", "is_open", "second_text")


def _grade_runs(executions, reextractions, keys, integer_guard) -> DataFrame:
    runs = with_printed(executions, integer_guard)
    return with_grade(_with_second_text(runs, reextractions, keys))


def grade_two_part(executions: DataFrame, reextractions: DataFrame, keys: list[str]) -> DataFrame:
    """Grades of the two-part subset: adds status and output."""
    return _grade_runs(executions, reextractions, keys, integer_guard=False)


def grade_math(executions: DataFrame, reextractions: DataFrame, keys: list[str]) -> DataFrame:
    """Grades of the math subset: an integer output gets no second look."""
    return _grade_runs(executions, reextractions, keys, integer_guard=True)


def grade_direct(
    answers: DataFrame,
    reextractions: DataFrame,
    keys: list[str],
    zero_is_integer: bool = False,
) -> DataFrame:
    """Grades of answers given as text (column ``answer``), without a program run."""
    answer, picked, solution = F.col("answer"), F.col("picked"), F.col("solution")
    staged = answers.withColumn("picked", direct_answer(answer, solution, zero_is_integer))
    flagged = staged.withColumn("is_open", answer_needs_second_look(picked, solution))
    looked = _with_second_text(flagged, reextractions, keys)
    grade = grade_answer(answer, picked, solution, F.col("is_open"), F.col("second_text"))
    return looked.withColumns({"status": grade.status, "output": grade.output}).drop(
        "second_text", "is_open", "picked"
    )


def second_look(mismatches: DataFrame, reextractions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``final_output``: the re-extracted text, or the first output, stripped."""
    texts = reextractions.select(*keys, F.col("text").alias("second_text"))
    joined = mismatches.join(texts, keys, "left")
    final = python_strip(F.coalesce("second_text", "stdout"))
    return joined.withColumn("final_output", final).drop("second_text")


def provider_failures_as_text(generations: DataFrame) -> DataFrame:
    """Two-part subset: a failed call becomes response text and is graded as such."""
    failed = F.concat(F.lit(PROVIDER_ERROR_PREFIX), F.col("provider_error"))
    return generations.withColumn("response", F.coalesce(failed, F.col("response")))


def drop_after_provider_failure(
    generations: DataFrame, keys: list[str], row_id: Column
) -> DataFrame:
    """Math subset: a failed call ends the passes of its problem.

    Only passes in front of the first failed one remain. The problems with a failure are sent to
    the rows while they are few; the rows of all others pass as they are.
    """
    first_failure = generations.groupBy(*keys).agg(
        F.min(F.when(F.col("provider_error").isNotNull(), F.col("kpass"))).alias("failed_at"),
        F.count("*").alias("group_rows"),
    )
    failed = F.col("failed_at").isNotNull()
    joined = join_sparse_values(generations, first_failure, keys, row_id, failed)
    kept = F.col("failed_at").isNull() | (F.col("kpass") < F.col("failed_at"))
    return joined.where(kept).drop("failed_at")


def outside_status_domain(rows: DataFrame) -> DataFrame:
    """Rows whose status is none of the known ones, null included."""
    return rows.where(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)))
