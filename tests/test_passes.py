"""Pass selection and gating against a loop over passes, as a run would make it."""

import random

import pytest

from gradeworks.operators import hotkeys
from gradeworks.operators import passes as P
from gradeworks.operators.dedup import dedup_codes, dedup_rows
from gradeworks.plans.evaluation import (
    best_of_k_accuracy,
    problem_results,
    two_part_results,
    with_texts,
)

SCHEMA = "row_no long, model string, year int, day int, part int, kpass int, status string"
KINDS = ["no_error", "wrong_output", "runtime_error", "syntax_error", "timeout_error"]


def random_attempts(seed, passes=4, copies=True):
    """Attempts with gaps, repeated pass numbers and a shuffled row order."""
    rng = random.Random(seed)
    rows = []
    for model in ("a", "b"):
        for day in (1, 2, 24, 25):
            for part in (1, 2):
                for kpass in range(passes):
                    for _ in range(rng.choice([0, 1, 1, 2] if copies else [1])):
                        rows.append((model, 2015 + rng.randint(0, 1), day, part, kpass,
                                     rng.choice(KINDS)))
    numbers = rng.sample(range(10_000), len(rows))
    return [(n, *r) for n, r in zip(numbers, rows)]


def first_rows(rows):
    """Per task and pass the row with the lowest number."""
    found = {}
    for row in sorted(rows):
        found.setdefault(row[1:5], {}).setdefault(row[5], row)
    return found


def select_best(passes, k):
    made = [passes[p] for p in sorted(passes) if p < k]
    for row in made:
        if row[6] == "no_error":
            return row
    return made[-1] if made else None


def as_set(frame, columns=("model", "year", "day", "part", "kpass", "status", "row_no")):
    return {tuple(r[c] for c in columns) for r in frame.collect()}


def expected_row(row):
    return (*row[1:7], row[0])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_best_of_k(frame, seed, k):
    rows = random_attempts(seed)
    best = {t: select_best(p, k) for t, p in first_rows(rows).items()}
    expected = {expected_row(r) for r in best.values() if r}
    assert as_set(P.best_of_k(frame(rows, SCHEMA), k)) == expected


def gated(rows, k):
    tasks = {t: select_best(p, k) for t, p in first_rows(rows).items()}
    out = set()
    for (model, year, day, part), row in tasks.items():
        if part != 1 or row is None:
            continue
        out.add(expected_row(row))
        second = tasks.get((model, year, day, 2))
        if row[6] != "no_error":
            out.add((model, year, day, 2, None, "part1_failed", None))
        elif second is not None and day != 25:
            out.add(expected_row(second))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_part_gating(frame, seed, k):
    rows = random_attempts(seed)
    assert as_set(P.part_gating(frame(rows, SCHEMA), k)) == gated(rows, k)


@pytest.mark.parametrize("gate", ["k", "1"])
def test_first_pass_gated(frame, gate):
    rows = random_attempts(4)
    tasks = first_rows(rows)
    expected = set()
    for (model, year, day, part), passes in tasks.items():
        first = passes.get(0)
        if first is None:
            continue
        if part == 2:
            ones = tasks.get((model, year, day, 1), {})
            best = select_best(ones, 3 if gate == "k" else 1)
            if day == 25 or best is None or best[6] != "no_error":
                continue
        expected.add(expected_row(first))
    assert as_set(P.first_pass_gated(frame(rows, SCHEMA), 3, gate)) == expected
    with pytest.raises(ValueError):
        P.first_pass_gated(frame(rows, SCHEMA), 3, "2")


def test_first_pass_with_gaps(frame):
    rows = random_attempts(5)
    expected = {expected_row(p[min(p)]) for p in first_rows(rows).values()}
    assert as_set(P.first_pass(frame(rows, SCHEMA), numbering="gaps")) == expected
    zero = {expected_row(p[0]) for p in first_rows(rows).values() if 0 in p}
    assert as_set(P.first_pass(frame(rows, SCHEMA))) == zero


def test_early_stop(frame):
    rows = random_attempts(6)
    stops = {}
    for row in rows:
        if row[6] == "no_error":
            stops[row[1:5]] = min(row[5], stops.get(row[1:5], row[5]))
    expected = {r[0] for r in rows if r[1:5] not in stops or r[5] <= stops[r[1:5]]}
    kept = P.early_stop(frame(rows, SCHEMA))
    assert sorted(kept.columns) == sorted([*frame(rows, SCHEMA).columns, "stop_pass"])
    assert sorted(r.row_no for r in kept.collect()) == sorted(expected)


def test_solving_never_falls_with_k(frame):
    rows = frame(random_attempts(8, passes=6), SCHEMA)
    solved = [P.best_of_k(rows, k).where("status = 'no_error'").count() for k in range(1, 7)]
    assert solved == sorted(solved)


def test_results_do_not_depend_on_partitioning(frame):
    rows = frame(random_attempts(9), SCHEMA)
    one = as_set(P.part_gating(rows.coalesce(1), 3))
    assert one == as_set(P.part_gating(rows.repartition(7), 3))


def test_accuracy_of_gated_results(frame):
    rows = random_attempts(10)
    results = [r for r in gated(rows, 3) if not (r[2] == 25 and r[3] == 2)]
    found = {r.model: r for r in best_of_k_accuracy(frame(rows, SCHEMA), 3).collect()}
    for model, row in found.items():
        mine = [r for r in results if r[0] == model]
        solved = [r for r in mine if r[5] == "no_error"]
        assert (row.total, row.solved) == (len(mine), len(solved))
        assert row.accuracy == 100.0 * len(solved) / len(mine)
        assert row.solved_part2 == len([r for r in solved if r[3] == 2])


def test_exported_rows_of_blocked_parts(frame):
    attempts = frame(
        [(7, "m", 2015, 1, 1, 0, "wrong_output", " out ", "", "print()")],
        SCHEMA + ", output string, stderr string, code string",
    )
    challenges = frame([(2015, 1, 1, "01"), (2015, 1, 2, "02")],
                       "year int, day int, part int, solution string")
    results = two_part_results(attempts, 3)
    best, first = results.where("k = 3"), results.where("k = 1")
    rows = {r.part: r for r in with_texts(best, attempts, challenges).collect()}
    assert rows[1].output == " out " and rows[1].kpass == 0
    assert (rows[2].status, rows[2].output, rows[2].expected_output, rows[2].code) == (
        "part1_failed", "", "02", "")
    assert rows[2].kpass is None
    assert [r.part for r in first.collect()] == [1]


PROBLEMS = "row_no long, model string, id int, kpass int, status string, provider_error string"


def test_a_failed_call_ends_the_passes_of_a_problem(frame):
    rows = frame(
        [
            (1, "m", 1, 0, "wrong_output", None),
            (2, "m", 1, 1, None, "down"),
            (3, "m", 1, 2, "no_error", None),
            (4, "m", 2, 0, "no_error", None),
            (5, "m", 2, 1, None, "down"),
            (6, "m", 3, 0, None, "down"),
            (7, "m", 4, 0, "wrong_output", None),
            (8, "m", 4, 1, "runtime_error", None),
        ],
        PROBLEMS,
    )
    columns = ("id", "kpass", "status", "row_no")
    best = {(2, 0, "no_error", 4), (4, 1, "runtime_error", 8)}
    first = {(1, 0, "wrong_output", 1), (2, 0, "no_error", 4), (4, 0, "wrong_output", 7)}
    results = problem_results(rows, 3)
    assert as_set(results.where("k = 3"), columns) == best
    assert as_set(results.where("k = 1"), columns) == first
    keys = ["model", "id"]
    assert as_set(P.first_pass(rows, keys, failed_calls=True), columns) == first
    for k in (3, 40):
        assert as_set(P.best_of_k(rows, k, keys, failed_calls=True), columns) == best


def test_a_failed_call_of_a_two_part_task_is_text(frame):
    schema = SCHEMA + ", provider_error string"
    rows = frame(
        [
            (1, "m", 2015, 1, 1, 0, "wrong_output", "down"),
            (2, "m", 2015, 1, 1, 1, "no_error", None),
            (3, "m", 2015, 1, 2, 0, "no_error", None),
        ],
        schema,
    )
    found = {(r.part, r.kpass, r.status) for r in P.part_gating(rows, 3).collect()}
    assert found == {(1, 1, "no_error"), (2, 0, "no_error")}


@pytest.mark.parametrize("k", [2, 17, 40, 1000])
def test_every_k_is_alike(frame, k):
    rows = frame(
        [
            (1, "m", 2015, 1, 1, 0, "wrong_output"),
            (2, "m", 2015, 1, 1, 1, None),
            (3, "m", 2015, 2, 1, -1, "no_error"),
            (4, "m", 2015, 2, 1, 0, "runtime_error"),
            (5, "m", 2015, 3, 1, 0, None),
        ],
        SCHEMA,
    )
    best = {(r.day, r.kpass, r.status, r.row_no) for r in P.best_of_k(rows, k).collect()}
    assert best == {(1, 1, None, 2), (2, -1, "no_error", 3), (3, 0, None, 5)}
    gated = {(r.day, r.part, r.kpass, r.status) for r in P.part_gating(rows, k).collect()}
    assert gated == {(1, 1, 1, None), (1, 2, None, "part1_failed"), (2, 1, -1, "no_error"),
                     (3, 1, 0, None), (3, 2, None, "part1_failed")}


def test_a_run_has_both_lists_with_their_k(frame):
    rows = frame(random_attempts(13), SCHEMA)
    found = two_part_results(rows, 3)
    assert as_set(found.where("k = 3")) == as_set(P.part_gating(rows, 3))
    assert as_set(found.where("k = 1")) == as_set(P.first_pass_gated(rows, 3))
    assert as_set(two_part_results(rows, 1)) == as_set(P.part_gating(rows, 1))


@pytest.mark.parametrize("piece, sent", [(1_000_000, 10), (100, 10), (7, 3)])
def test_hot_groups_are_split_and_whole(frame, spark, monkeypatch, piece, sent):
    monkeypatch.setattr(hotkeys, "PIECE_ROWS", piece)
    monkeypatch.setattr(hotkeys, "SENT_KEYS", sent)
    rows = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS key"
    )
    groups = rows.groupBy("key").agg({"id": "max", "*": "count"}).withColumnsRenamed(
        {"max(id)": "top", "count(1)": "group_rows"}
    )
    joined = hotkeys.join_group_values(rows, groups, ["key"], rows.id)
    assert joined.columns == ["key", "id", "top"]
    assert joined.count() == 3000 == joined.select("id").distinct().count()
    expected = {r.key: r.top for r in groups.collect()}
    assert all(expected[r.key] == r.top for r in joined.collect())


def test_rows_without_a_key_are_kept(frame):
    rows = frame([(1, None, 2015, 1, 1, 0, "no_error"), (2, None, 2015, 1, 1, 1, "no_error")],
                 SCHEMA)
    assert [r.row_no for r in P.early_stop(rows).collect()] == [1]


def test_group_aggregate_runs_once(frame, tmp_path):
    frame(random_attempts(1), SCHEMA).write.parquet(str(tmp_path / "a"))
    kept = P.early_stop(frame([], SCHEMA).sparkSession.read.parquet(str(tmp_path / "a")))
    kept.collect()
    text = kept._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")]
    assert final.count("partial_min") == 1


def test_dedup_keeps_first_or_last(frame):
    rows = frame([(3, 1, "no_error", "c"), (1, 1, "wrong_output", "a"), (2, 2, "no_error", "b"),
                  (2, 2, "no_error", "b")],
                 "row_no long, id int, status string, code string")
    first = {(r.id, r.code) for r in dedup_rows(rows, ["id"], "first").collect()}
    last = {(r.id, r.code) for r in dedup_rows(rows, ["id"], "last").collect()}
    assert first == {(1, "a"), (2, "b")} and last == {(1, "c"), (2, "b")}
    codes = {(r.id, r.code) for r in dedup_codes(rows, ["id"], "last").collect()}
    assert codes == {(1, 1), (2, 1)}
    with pytest.raises(ValueError):
        dedup_rows(rows, ["id"], "any")


def test_selection_is_hash_aggregation_without_python(frame):
    rows = frame(random_attempts(1), SCHEMA)
    plan = P.part_gating(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "Window" not in plan and "Python" not in plan
    assert plan.count("Exchange") == 2


@pytest.mark.parametrize("sparse_rows", [1_000_000, 3])
def test_values_of_many_groups_are_joined(frame, monkeypatch, sparse_rows):
    """Beyond the bound of sparse values the same rows come out of a join of all groups."""
    rows = random_attempts(17)
    table = frame(rows, SCHEMA)
    wanted = [as_set(P.early_stop(table)), as_set(dedup_rows(table, ["model", "year", "day", "part"], "last"))]
    monkeypatch.setattr(hotkeys, "SPARSE_BYTES", -1)
    monkeypatch.setattr(hotkeys, "SPARSE_ROWS", sparse_rows)
    monkeypatch.setattr(hotkeys, "PIECE_ROWS", 3)
    found = [as_set(P.early_stop(table)), as_set(dedup_rows(table, ["model", "year", "day", "part"], "last"))]
    assert found == wanted


def test_texts_of_many_results_are_attached(frame, monkeypatch):
    attempts = frame([(i, f"text {i}") for i in range(20)], "row_no long, output string")
    results = frame([("a", 3), ("b", None), ("c", 7)], "task string, row_no long")
    wanted = {("a", 3, "text 3"), ("b", None, None), ("c", 7, "text 7")}
    assert {tuple(r) for r in P.attach_texts(results, attempts, ["output"]).collect()} == wanted
    monkeypatch.setattr(hotkeys, "SPARSE_BYTES", -1)
    monkeypatch.setattr(hotkeys, "SPARSE_ROWS", 1)
    assert {tuple(r) for r in P.attach_texts(results, attempts, ["output"]).collect()} == wanted
