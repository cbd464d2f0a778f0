"""Reports against pandas, which the result files were evaluated with."""

import random

import pandas as pd
import pytest

from gradeworks.operators import reports as R
from gradeworks.operators.findings import findings_summary
from gradeworks.plans.leaderboard import error_report, leaderboards

T_SCHEMA = "row_no long, model string, year int, day int, part int, status string"
M_SCHEMA = "row_no long, model string, id int, status string"
KINDS = ["no_error", "wrong_output", "runtime_error", "syntax_error", "timeout_error",
         "part1_failed"]


def two_part_rows(seed=1, models=("a", "b")):
    rng = random.Random(seed)
    return [
        (i, rng.choice(models), 2015 + rng.randint(0, 2), rng.choice([1, 2, 24, 25]),
         rng.randint(1, 2), rng.choice(KINDS))
        for i in range(200)
    ]


def math_rows(seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), rng.randint(1, 60), rng.choice(KINDS[:5])) for i in range(200)]


def as_pandas(rows, schema, model):
    names = [c.split()[0] for c in schema.split(", ")]
    table = pd.DataFrame(rows, columns=names)
    return table[table.model == model]


def test_accuracy_two_part(frame):
    rows = two_part_rows()
    names = [c.split()[0] for c in T_SCHEMA.split(",")]
    last = {}
    for row in sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda r: r["row_no"]):
        if (row["day"], row["part"]) != (25, 2):
            last[row["model"], row["year"], row["day"], row["part"]] = row["status"]
    for found in R.accuracy_two_part(frame(rows, T_SCHEMA), ["model"]).collect():
        own = {task[-1:] + task[1:3]: s for task, s in last.items() if task[0] == found.model}
        solved = [task for task, status in own.items() if status == "no_error"]
        assert (found.total, found.solved) == (len(own), len(solved))
        assert found.accuracy == pytest.approx(100 * len(solved) / len(own))
        assert found.solved_part1 == len([task for task in solved if task[0] == 1])


def test_accuracy_math(frame):
    rows = math_rows()
    for row in R.accuracy_math(frame(rows, M_SCHEMA), ["model"]).collect():
        table = as_pandas(rows, M_SCHEMA, row.model).drop_duplicates(["id"])
        solved = (table.status == "no_error").sum()
        assert row.accuracy == pytest.approx(solved / len(table) * 100)


def test_a_missing_part_has_a_null_share(frame):
    rows = frame([(1, "a", 2015, 1, 1, "no_error"), (2, "b", 2015, 25, 2, "no_error")], T_SCHEMA)
    found = R.accuracy_two_part(rows, ["model"]).collect()
    assert [(r.model, r.accuracy_part1, r.accuracy_part2) for r in found] == [("a", 100.0, None)]


def test_kind_is_told_by_columns(frame):
    assert R.is_two_part(["year", "day", "part"]) and not R.is_two_part(["id", "status"])
    two, math = frame(two_part_rows(), T_SCHEMA), frame(math_rows(), M_SCHEMA)
    assert "total_part1" in R.accuracy(two, ["model"]).columns
    assert "total_part1" not in R.accuracy(math, ["model"]).columns


def test_status_counts(frame):
    rows = math_rows()
    for row in R.status_counts(frame(rows, M_SCHEMA), ["model"]).collect():
        table = as_pandas(rows, M_SCHEMA, row.model).drop_duplicates(["id"])
        assert row.syntax_error == (table.status == "syntax_error").sum()
        assert row.timeout_error == (table.status == "timeout_error").sum()
    assert "part1_failed" in R.status_counts(frame(two_part_rows(), T_SCHEMA), ["model"]).columns


def test_error_shares(frame):
    rows = two_part_rows(3)
    for row in R.error_shares(frame(rows, T_SCHEMA), ["model"]).collect():
        table = as_pandas(rows, T_SCHEMA, row.model).drop_duplicates(["year", "day", "part"])
        failed = table[~table.status.isin(["no_error", "part1_failed"])]
        assert row.total_errors == len(failed)
        assert row.wrong_outputs == pytest.approx((failed.status == "wrong_output").mean())
        shares = [row[c] for c in R.ERROR_SHARES]
        assert sum(shares) == pytest.approx(1.0)


def test_error_report(frame):
    path = "/r/m-1/m_1-{}-pass@3.csv"
    rows = frame(
        [
            (1, path.format("aoc"), 2015, 1, 1, None, "no_error"),
            (1, path.format("euler"), None, None, None, 1, "wrong_output"),
            (2, path.format("euler"), None, None, None, 1, "no_error"),
            (3, path.format("euler"), None, None, None, 2, "runtime_error"),
            (4, path.format("euler"), None, None, None, 3, "no_output"),
            (1, path.format("other"), None, None, None, 1, "wrong_output"),
        ],
        FILES,
    )
    found = {r.subset: r for r in error_report(rows).collect()}
    assert set(found) == {"aoc", "euler"}
    assert found["aoc"].total_errors == 0 and found["aoc"].wrong_outputs is None
    assert (found["euler"].label, found["euler"].total_errors) == ("Euler", 3)
    assert (found["euler"].wrong_outputs, found["euler"].wrong_outputs_bucket) == (33.3, 6)


def test_labels(frame):
    rows = frame([("aoc_converted",), ("odd",)], "subset string")
    assert {r.subset: r.label for r in R.with_subset_label(rows).collect()} == {
        "aoc_converted": "AoC-Leet", "odd": None}
    assert [r.subset for r in R.without_subset_label(rows).collect()] == ["odd"]


def test_solved_by_day(frame):
    rows = two_part_rows(5)
    found = R.solved_by_day(frame(rows, T_SCHEMA)).orderBy("day").collect()
    assert [r.day for r in found] == list(range(1, 25))
    for row in found:
        ok = [r for r in rows if r[3] == row.day and r[5] == "no_error"]
        assert row.part1_solved == len([r for r in ok if r[4] == 1])
        assert row.part2_solved == len([r for r in ok if r[4] == 2])


def test_day_series_keeps_unsolved_files(frame):
    rows = frame([("/r/x/a-aoc-pass@1.csv", 25, 1, "no_error"), ("b.csv", 2, 2, "no_error")],
                 "path string, day int, part int, status string")
    found = R.solved_by_day_series(rows, "path").collect()
    assert len(found) == 48
    assert {(r.series, r.day): r.solved for r in found if r.solved} == {("b", 2): 1}


FILES = "row_no long, path string, year int, day int, part int, id int, status string"


def file_rows():
    two = "/runs/x/{}-{}-pass@{}.csv"
    rows = [
        (0, two.format("m_1", "aoc", 3), 2015, 1, 1, None, "no_error"),
        (1, two.format("m_1", "aoc", 3), 2015, 1, 1, None, "wrong_output"),
        (2, two.format("m_1", "aoc", 3), 2015, 25, 2, None, "wrong_output"),
        (3, two.format("m_1", "aoc", 3), 2015, 2, 1, None, "no_error"),
        (0, two.format("m_1", "aoc_converted", 3), 2015, 1, 1, None, "no_error"),
        (0, two.format("m_1", "euler", 3), None, None, None, 1, "no_error"),
        (1, two.format("m_1", "euler", 3), None, None, None, 1, "wrong_output"),
        (0, two.format("m_1", "euler_stories", 3), None, None, None, 1, "wrong_output"),
        (0, two.format("m2", "euler", 1), None, None, None, 1, "no_error"),
        (0, "/runs/y/m2-euler-pass@1.csv", None, None, None, 1, "wrong_output"),
        (0, two.format("m2", "euler", 3), None, None, None, 1, "no_error"),
        (0, two.format("m-3", "euler", 3), None, None, None, 1, "no_error"),
        (0, two.format("m3", "other", 3), None, None, None, 1, "no_error"),
        (0, "/runs/x/m3-euler-pass@3.txt", None, None, None, 1, "no_error"),
    ]
    return rows


def test_cube_leaderboard_and_ranking(frame):
    tables = leaderboards(frame(file_rows(), FILES))
    cube = {(r.model, r.subset, r.variant, r.k): r.accuracy for r in tables["cube"].collect()}
    assert cube == {
        ("m_1", "aoc", "original", 3): 50.0,
        ("m_1", "aoc", "leet", 3): 100.0,
        ("m_1", "euler", "original", 3): 100.0,
        ("m_1", "euler", "story", 3): 0.0,
        ("m2", "euler", "original", 1): 0.0,
        ("m2", "euler", "original", 3): 100.0,
    }
    board = {r.model: r for r in tables["models"].collect()}
    assert board["m-1"].aoc_original_k3 == 50.0 and board["m-1"].aoc_original_k1 is None
    ranking = {r.model: (r.score, r.rank, r.incomplete) for r in tables["ranking"].collect()}
    assert ranking == {"m2": (100.0, 1, True), "m_1": (62.5, 2, False)}


def test_ranks_equal_a_global_rank(frame, spark):
    rng = random.Random(2)
    scores = [rng.choice([0.0, 12.5, 100.0, None, rng.random() * 100]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(scores)), "i int, score double")
    found = {r.i: r["rank"] for r in R.ranked(rows, "score").collect()}
    expected = pd.Series(scores).rank(method="min", ascending=False)
    assert {i: r for i, r in found.items() if r is not None} == {
        i: int(r) for i, r in expected.items() if r == r
    }
    assert len(found) == 300


def test_findings(frame):
    findings = frame([("m", 1, "warning"), ("m", 1, "error"), ("m", 1, "error")],
                     "model string, snippet_id int, category string")
    snippets = frame([("m", 1, 10), ("m", 2, 20), ("n", 3, 0)],
                     "model string, snippet_id int, code_lines int")
    found = {r.model: r for r in findings_summary(findings, snippets).collect()}
    assert (found["m"].findings, found["m"].error, found["m"].clean_snippets) == (3, 2, 1)
    assert found["m"].findings_per_100_lines == 10.0
    assert found["n"].findings_per_100_lines is None and found["n"].findings == 0
