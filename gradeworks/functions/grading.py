"""Grading expressions: error class, comparison and second look, as ``when`` chains."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeworks.fixed_values import (
    NO_ERROR,
    RUNTIME_ERROR,
    SYNTAX_ERROR,
    SYNTAX_MARK,
    TIMEOUT_ERROR,
    TIMEOUT_MARK,
    WRONG_OUTPUT,
)
from gradeworks.functions.text import is_integer_text, only_last_integer, python_strip


@dataclass(frozen=True)
class Grade:
    """Status and effective output of one attempt."""

    status: Column
    output: Column


def classify_error(stderr: Column) -> Column:
    """Error class of a non-empty standard error text."""
    return (
        F.when(stderr.contains(SYNTAX_MARK), SYNTAX_ERROR)
        .when(stderr.contains(TIMEOUT_MARK), TIMEOUT_ERROR)
        .otherwise(RUNTIME_ERROR)
    )


def printed_text(stdout: Column) -> Column:
    """The output as it is compared: stripped, never null."""
    return python_strip(F.coalesce(stdout, F.lit("")))


def matches(output: Column, solution: Column) -> Column:
    """Stripped output equals the solution; the solution is compared as it stands."""
    return printed_text(output).eqNullSafe(solution)


def is_nonzero_integer(solution: Column) -> Column:
    """The solution is an integer other than 0."""
    return is_integer_text(solution) & solution.rlike("[1-9]")


def clean_run(stderr: Column) -> Column:
    """The run left no error text. Never null."""
    return F.coalesce(stderr, F.lit("")) == ""


def needs_second_look(
    printed: Column, stderr: Column, solution: Column, integer_guard: bool
) -> Column:
    """The run was clean, the output is no match, and no guard settles it. Never null.

    ``printed`` is the stripped output. With ``integer_guard`` an output that is already
    an integer gets no second look.
    """
    open_case = clean_run(stderr) & ~printed.eqNullSafe(solution)
    return open_case & ~is_integer_text(printed) if integer_guard else open_case


def grade_run(
    stdout: Column, printed: Column, stderr: Column, solution: Column, is_open: Column, second_text: Column
) -> Grade:
    """Grade one run; ``is_open`` is ``needs_second_look``, ``second_text`` the re-extracted answer or null."""
    second = F.coalesce(python_strip(second_text), printed)
    second_ok = is_open & second.eqNullSafe(solution)
    status = (
        F.when(~clean_run(stderr), classify_error(stderr))
        .when(printed.eqNullSafe(solution) | second_ok, NO_ERROR)
        .otherwise(WRONG_OUTPUT)
    )
    output = F.when(second_ok, second).otherwise(F.coalesce(stdout, F.lit("")))
    return Grade(status, output)


def direct_answer(answer: Column, solution: Column, zero_is_integer: bool = False) -> Column:
    """The part of a free-text answer that is compared with the solution.

    For an integer solution it is the last run of digits. A solution of 0 is only
    treated so with ``zero_is_integer``.
    """
    wanted = is_integer_text(solution) if zero_is_integer else is_nonzero_integer(solution)
    return printed_text(F.when(wanted, only_last_integer(answer)).otherwise(answer))


def answer_needs_second_look(picked: Column, solution: Column) -> Column:
    """The picked answer is no match and not settled by being an integer."""
    return ~picked.eqNullSafe(solution) & ~is_integer_text(picked)


def grade_answer(
    answer: Column, picked: Column, solution: Column, is_open: Column, second_text: Column
) -> Grade:
    """Grade an answer given as text, of which ``picked`` is compared; no program ran."""
    second = F.coalesce(python_strip(second_text), picked)
    second_ok = is_open & second.eqNullSafe(solution)
    solved = picked.eqNullSafe(solution) | second_ok
    status = F.when(solved, NO_ERROR).otherwise(WRONG_OUTPUT)
    return Grade(status, F.when(second_ok, second).otherwise(answer))
