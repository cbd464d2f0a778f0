"""Grading rules on inline rows."""

import random

import pytest
from pyspark.sql import functions as F

from gradeworks.fixed_values import STATUSES
from gradeworks.functions.grading import classify_error, direct_answer
from gradeworks.operators import grading as G

RUN = "row_no int, stdout string, stderr string, solution string"
TEXTS = "row_no int, text string"


def graded(function, frame, runs, texts):
    rows = function(frame(runs, RUN), frame(texts, TEXTS), ["row_no"]).collect()
    return {r.row_no: (r.status, r.output) for r in rows}


RUNS = [
    (1, " 5 \n", "", "5"),
    (2, "the answer is 5", "", "5"),
    (3, "the answer is 5", "", "5"),
    (4, "6\n", "", "5"),
    (5, "5", "warning: deprecated", "5"),
    (6, "", "SyntaxError: TIMEOUT", "5"),
    (7, "", "TIMEOUT", "5"),
    (8, "", "IndentationError: x", "5"),
    (9, "", "", "5"),
    (10, "5", None, "5"),
    (11, "5", "", " 5"),
    (12, "", "", ""),
    (13, None, "", "5"),
]
SECOND = [(2, " 5\n"), (4, "5"), (9, "5"), (5, "5")]


def test_two_part_grades(frame):
    assert graded(G.grade_two_part, frame, RUNS, SECOND) == {
        1: ("no_error", " 5 \n"),
        2: ("no_error", "5"),
        3: ("wrong_output", "the answer is 5"),
        4: ("no_error", "5"),
        5: ("runtime_error", "5"),
        6: ("syntax_error", ""),
        7: ("timeout_error", ""),
        8: ("runtime_error", ""),
        9: ("no_error", "5"),
        10: ("no_error", "5"),
        11: ("wrong_output", "5"),
        12: ("no_error", ""),
        13: ("wrong_output", ""),
    }


def test_math_grades_differ_only_by_the_integer_guard(frame):
    two_part = graded(G.grade_two_part, frame, RUNS, SECOND)
    math = graded(G.grade_math, frame, RUNS, SECOND)
    assert {k for k in math if math[k] != two_part[k]} == {4}
    assert math[4] == ("wrong_output", "6\n")


def test_error_class_order(evaluate):
    texts = ["SyntaxError: TIMEOUT", "TIMEOUT", "SyntaxError", "x", ""]
    assert evaluate(classify_error, texts) == [
        "syntax_error", "timeout_error", "runtime_error", "runtime_error", "runtime_error",
    ]


def test_direct_answers(frame):
    rows = frame(
        [
            (1, "it is 12 or 13.", "13"),
            (2, "it is 12", "13"),
            (3, "result 0", "0"),
            (4, "no digits", "13"),
            (5, " red ", "red"),
            (6, "I say red", "red"),
        ],
        "row_no int, answer string, solution string",
    )
    texts = frame([(4, "13"), (6, "red"), (2, "13")], TEXTS)
    found = {r.row_no: (r.status, r.output) for r in
             G.grade_direct(rows, texts, ["row_no"]).collect()}
    assert found == {
        1: ("no_error", "it is 12 or 13."),
        2: ("wrong_output", "it is 12"),
        3: ("wrong_output", "result 0"),
        4: ("no_error", "13"),
        5: ("no_error", " red "),
        6: ("no_error", "red"),
    }
    zero = G.grade_direct(rows, texts, ["row_no"], zero_is_integer=True)
    assert zero.where("row_no = 3").first().status == "no_error"


def test_direct_answer_takes_the_last_digits(spark):
    row = spark.range(1).select(
        direct_answer(F.lit("a 1.25 b"), F.lit("25")).alias("x"),
        direct_answer(F.lit(" a 1 "), F.lit("a")).alias("y"),
    )
    assert tuple(row.first()) == ("25", "a 1")


def test_effective_code(frame):
    rows = frame([(1, "x=1", True), (2, "Sure: ```python\ny=2```", False), (3, "a b", False), (4, "", True),
                  (5, "```z```", None)], "row_no int, response string, valid boolean")
    found = {r.row_no: r.code for r in G.with_effective_code(rows).collect()}
    assert found == {1: "x=1", 2: "\ny=2", 3: "a b", 4: "", 5: "z"}
    rates = G.syntax_rates(rows.withColumn("model", F.lit("m")), ["model"]).first()
    assert (rates.responses, rates.valid) == (5, 2)


def test_timeouts(frame):
    rows = frame([(1, "o", "e", 60.0), (2, "o", "e", 60.5), (3, "o", "", None)],
                 "row_no int, stdout string, stderr string, duration_s double")
    found = {r.row_no: (r.stdout, r.stderr) for r in G.mark_timeouts(rows).collect()}
    assert found == {1: ("o", "e"), 2: ("", "TIMEOUT"), 3: ("o", "")}


def test_warnings_can_be_ignored(frame):
    rows = frame([(1, "warn", 0), (2, "bad", 1), (3, "bad", None)],
                 "row_no int, stderr string, exit_code int")
    found = {r.row_no: r.stderr for r in G.ignore_warnings(rows).collect()}
    assert found == {1: "", 2: "bad", 3: "bad"}


def test_provider_failures(frame):
    schema = "row_no int, model string, id int, kpass int, response string, provider_error string"
    rows = frame(
        [
            (1, "m", 1, 0, "a", None),
            (2, "m", 1, 1, None, "down"),
            (3, "m", 1, 2, "c", None),
            (4, "m", 2, 0, None, "down"),
            (5, "m", 3, 0, "e", None),
        ],
        schema,
    )
    kept = G.drop_after_provider_failure(rows, ["model", "id"], F.col("row_no"))
    assert sorted(r.row_no for r in kept.collect()) == [1, 5]
    texts = {r.row_no: r.response for r in G.provider_failures_as_text(rows).collect()}
    assert texts[2] == "ProviderError: down" and texts[1] == "a"


def test_status_domain(frame):
    rows = frame([(s,) for s in [*STATUSES, "odd", None]], "status string")
    assert {r.status for r in G.outside_status_domain(rows).collect()} == {"odd", None}


def test_grades_do_not_depend_on_partitioning(frame):
    rng = random.Random(3)
    pool = ["5", " 5 ", "6", "x 5", ""]
    runs = [(i, rng.choice(pool), rng.choice(["", "", "E"]), "5") for i in range(200)]
    texts = [(i, rng.choice(pool)) for i in range(0, 200, 2)]
    rows = frame(runs, RUN)
    one = G.grade_math(rows.coalesce(1), frame(texts, TEXTS), ["row_no"])
    many = G.grade_math(rows.repartition(7), frame(texts, TEXTS).repartition(3), ["row_no"])
    assert sorted(one.collect()) == sorted(many.collect())
    assert "no_output" not in {r.status for r in one.collect()}


@pytest.mark.parametrize("status", STATUSES)
def test_status_codes_round_trip(spark, status):
    from gradeworks.functions.status import status_code, status_name

    assert spark.range(1).select(status_name(status_code(F.lit(status)))).first()[0] == status
