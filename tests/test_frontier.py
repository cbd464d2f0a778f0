"""What is due after some attempts, task by task, and merging attempts piece by piece."""

import random

from gradeworks.operators import frontier as R
from gradeworks.operators.passes import pass_table
from gradeworks.operators.tasks import TaskSpan
from gradeworks.sources.snapshots import by_year, read_snapshot
from test_passes import SCHEMA, random_attempts


def due_by_rule(attempts, days, k):
    """Task by task: (part, next pass, row that solved part 1)."""
    first = {}
    for row, model, year, day, part, kpass, status in sorted(attempts):
        first.setdefault((model, year, day, part, kpass), (status, row))
    found = {}
    for model, year, day in days:
        made = {p: {q: first[key] for q in range(-1, k) if (key := (model, year, day, p, q)) in first} for p in (1, 2)}
        solved = {p: [q for q, (s, _) in made[p].items() if s == "no_error"] for p in made}
        following = {p: max(made[p], default=-1) + 1 for p in made}
        if not solved[1]:
            if following[1] < k:
                found[model, year, day] = (1, following[1], None)
        elif day != 25 and not solved[2] and following[2] < k:
            found[model, year, day] = (2, following[2], made[1][min(solved[1])][1])
    return found


def test_due_days(spark, frame):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    order = ["row_no", "model", "year", "day", "part", "kpass", "status"]
    rows = random_attempts(5)
    plain = [tuple(dict(zip(columns, r, strict=True))[c] for c in order) for r in rows]
    years, models = sorted({r[2] for r in plain}), sorted({r[1] for r in plain})
    days = sorted({r[3] for r in plain} | {25, 3})
    challenges = frame([(y, d) for y in years for d in days], "year int, day int")
    span = TaskSpan((min(years), max(years)), (1, 25))
    wanted = R.run_days(challenges, frame([(m,) for m in models], "model string"), span)
    found = R.due_days(wanted, pass_table(frame(rows, SCHEMA)), 3).collect()
    keys = [(m, y, d) for m in models for y in years for d in days]
    assert {(r.model, r.year, r.day): (r.part, r.kpass, r.solved_row) for r in found} == due_by_rule(plain, keys, 3)


def test_merging_in_lots_equals_merging_at_once(spark, frame, tmp_path):
    rows = random_attempts(9)
    random.Random(1).shuffle(rows)
    whole, lots = str(tmp_path / "whole"), str(tmp_path / "lots")
    R.merge_attempts(frame(rows, SCHEMA), whole, by_year())
    for part in (rows[:40], rows[30:90], rows[90:], rows[:10]):
        R.merge_attempts(frame(part, SCHEMA), lots, by_year())
    assert sorted(R.kept_passes(spark, lots).collect()) == sorted(R.kept_passes(spark, whole).collect())


def test_other_segments_are_not_read(spark, frame, tmp_path):
    """Attempts of one year: the state of another year is neither read nor written again."""
    root = str(tmp_path / "state")
    rows = [(1, "m", 2015, 1, 1, 0, "no_error"), (2, "m", 2016, 1, 1, 0, "wrong_output")]
    R.merge_attempts(frame(rows, SCHEMA), root, by_year())
    R.merge_attempts(frame([(3, "m", 2016, 1, 1, 1, "no_error")], SCHEMA), root, by_year())
    assert {(r.year, r.kpass) for r in R.kept_passes(spark, root).collect()} == {(2015, 0), (2016, 0), (2016, 1)}
    written = [p.name for p in (tmp_path / "state" / "data").glob("*/_segment=*")]
    assert sorted(written) == ["_segment=2015", "_segment=2016", "_segment=2016"]
    one = read_snapshot(spark, root, R.kept_passes(spark, root).schema, segments=["2016"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "/2015" not in plan
