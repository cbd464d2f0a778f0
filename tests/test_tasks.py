"""Corpus reshaping, filters and resume rules."""

import json

from pyspark.sql import functions as F

from gradeworks.operators import tasks as T
from gradeworks.plans.corpus import refreshed_corpus

FLAT = (
    "year int, day int, part1 string, part1_converted string, part1_solution string, "
    "part2 string, part2_converted string, part2_solution string, input string"
)
CHALLENGES = [
    (2015, 1, "a", "ca", "01", "b", None, "2", "in"),
    (2015, 2, "c", "cc", "3", "d", "cd", "1,2", None),
    (2017, 25, "e", None, "#\n#", "f", "cf", "", "in"),
]
DAYS = "year int, day int, part int"


def days(table):
    return sorted((r.year, r.day) for r in table.collect())


def test_ranges(frame):
    rows = frame([(2015, 1, 1), (2015, 1, 2), (2022, 25, 1), (2023, 1, 1)], DAYS)
    assert days(T.in_range(rows, T.TaskSpan())) == [(2015, 1), (2015, 1), (2022, 25)]
    assert days(T.in_range(rows, T.TaskSpan(years=(2022, 2022)))) == [(2022, 25)]
    assert days(T.in_range(rows, T.TaskSpan((2015, 2015), (1, 1), parts=(1,)))) == [(2015, 1)]
    assert T.TaskSpan(years=(2016, 2016)).days == (1, 25)


def test_final_part2_is_dropped_null_safely(frame):
    rows = frame([(2015, 25, 2), (2015, 25, 1), (2015, 24, 2), (None, None, None)], DAYS)
    assert T.drop_final_part2(rows).count() == 3


def test_parts_as_rows_and_coverage(frame):
    rows = frame(CHALLENGES, FLAT)
    parts = {(r.year, r.day, r.part): r.solution for r in T.parts_as_rows(rows).collect()}
    assert parts[(2017, 25, 2)] == "" and parts[(2015, 1, 1)] == "01" and len(parts) == 6
    coverage = T.field_coverage(rows).first()
    assert tuple(coverage) == (3, 2, 2, 2)


def test_choose_description(frame):
    rows = T.parts_as_rows(frame(CHALLENGES, FLAT)).where("year = 2015 AND day = 1 AND part = 1")
    pick = lambda s: rows.select(
        T.choose_description(s, F.col("description"), F.col("converted"))
    ).first()[0]
    assert (pick(True), pick(False)) == ("a", "ca")


def test_resume_needs_exactly_two_rows(frame):
    corpus = frame(CHALLENGES, FLAT)
    done = frame([(2015, 1, 1), (2015, 1, 2), (2015, 2, 1), (2017, 25, 1)], DAYS)
    assert days(T.resume_days(corpus, done)) == [(2015, 2), (2017, 25)]
    assert days(T.resume_days(corpus, done, count_final_day=True)) == [(2015, 2)]
    assert T.resume_days(corpus, done, count_final_day=True, only_part_one=True).count() == 0
    three = done.unionByName(frame([(2015, 1, 2)], DAYS))
    assert (2015, 1) in days(T.resume_days(corpus, three))


def test_ignored_ids(frame):
    kept = T.resume_problems(frame([(1,), (2,)], "id int"), frame([(2,)], "id int"))
    assert [r.id for r in kept.collect()] == [1]


def test_keys(frame, spark):
    corpus = frame(CHALLENGES, FLAT)
    assert T.key_violations(corpus, ["year", "day"]).count() == 0
    assert T.key_violations(corpus, ["year"]).first().rows == 2
    assert days(T.missing_keys(spark, corpus)) == [(2015, 25), (2017, 1), (2017, 2)]
    assert days(T.missing_keys(spark, corpus, T.TaskSpan((2015, 2015), (1, 24)))) == []
    found = T.look_up(frame([(2015, 2, 1)], DAYS), corpus).collect()
    assert [r.part1_solution for r in found] == ["3"]


def test_backfill_keeps_other_fields(frame):
    fresh = frame([(2015, 1, "new", None)], "year int, day int, part1 string, part2 string")
    corpus = frame(CHALLENGES, FLAT)
    found = T.backfill_descriptions(corpus, fresh)
    assert found.columns == corpus.columns
    row = found.where("year = 2015 AND day = 1").first()
    assert (row.part1, row.part2, row.part1_solution) == ("new", "b", "01")


def test_refreshed_corpus(frame):
    raw = frame([(2015, 1, "\\--- A\nnew story\n", None), (2015, 2, "nothing", None)],
                "year int, day int, text string, input string")
    found = {(r.year, r.day): r.part1 for r in
             refreshed_corpus(frame(CHALLENGES, FLAT), raw).collect()}
    assert found == {(2015, 1): "\\--- A\nnew story\n", (2015, 2): "c", (2017, 25): "e"}


def test_assembled_records(frame):
    parts = frame([(2015, 1, 1, 9, "a", "01"), (2015, 1, 1, 5, "z", "99"), (2015, 1, 2, 1, "b", "2"),
                   (2015, 2, 1, 2, "c", "3"), (2015, 2, 1, 2, "c", "3")],
                  "year int, day int, part int, row_no int, description string, answer string")
    inputs = frame([(2015, 1, "in")], "year int, day int, input string")
    found = {r.day: json.loads(r.j) for r in T.assemble_challenges(parts, inputs).select(
        "day", F.to_json(F.struct("year", "day", "part1", "part2", "input")).alias("j")).collect()}
    assert found[1] == {
        "year": 2015, "day": 1, "input": "in",
        "part1": {"description": "a", "answer": "01"},
        "part2": {"description": "b", "answer": "2"},
    }
    assert "part2" not in found[2] and "input" not in found[2]


def test_failures_only(frame):
    rows = frame([("no_error",), ("part1_failed",), ("no_output",), (None,)], "status string")
    assert [r.status for r in T.failures_only(rows).collect()] == ["no_output", None]


def test_tasks_without_one_challenge(frame):
    tasks = frame([(2015, 1), (2015, 1), (2015, 2), (2015, 3)], "year int, day int")
    challenges = frame([(2015, 1, "a"), (2015, 2, "b"), (2015, 2, "c")], "year int, day int, text string")
    looked = [(r.day, r.text) for r in T.look_up(tasks, challenges).collect()]
    assert sorted(looked, key=str) == [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, None)]
    faults = {(r.day, r.tasks, r.challenges) for r in T.look_up_faults(tasks, challenges).collect()}
    assert faults == {(2, 1, 2), (3, 1, 0)}


def test_run_order(frame):
    rows = T.ordered_tasks(frame([(2016, 1, 1), (2015, 2, 1), (2015, 1, 1)], DAYS))
    assert [(r.year, r.day) for r in rows.collect()] == [(2015, 1), (2015, 2), (2016, 1)]
