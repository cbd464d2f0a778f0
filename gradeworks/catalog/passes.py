"""Queries: passes, gating and copies of result rows."""

from pyspark.sql import functions as F

from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query, View
from gradeworks.catalog.grading import in_time_sql, runs_sql
from gradeworks.operators.dedup import dedup_rows
from gradeworks.operators.passes import attach_texts, best_of_k, early_stop, first_pass, first_pass_gated
from gradeworks.operators.passes import part_gating as gate_parts
from gradeworks.operators.tasks import ordered_tasks, parts_as_rows
from gradeworks.plans.evaluation import (
    best_of_k_accuracy,
    graded_attempts,
    graded_problems,
    problem_results,
    two_part_results,
    with_problem_texts,
    with_texts,
)
from gradeworks.schemas import PART_KEYS, PROBLEM_KEYS
from gradeworks.session import new_table_path
from gradeworks.sources.writers import write_attempts, write_results

K = 3
TASK = "model, year, day, part"


def passes_sql(k: int = K, attempts: str = V.ATTEMPTS.sql) -> str:
    """Common tables: attempts ``a``, one row per pass ``p``, best of k ``b``."""
    return f"""
    WITH a AS ({attempts}),
    p AS (SELECT {TASK}, kpass, first(status ORDER BY row_no) AS status, min(row_no) AS row_no
          FROM a WHERE kpass < {k} GROUP BY {TASK}, kpass),
    o AS (SELECT *, row_number() OVER (PARTITION BY {TASK} ORDER BY
            CASE WHEN status = 'no_error' THEN kpass ELSE 1000 - kpass END) AS rn FROM p),
    b AS (SELECT {TASK}, kpass, status, row_no FROM o WHERE rn = 1)"""


def gated_sql(k: int = K, attempts: str = V.ATTEMPTS.sql) -> str:
    """``passes_sql`` and the gated results ``g``."""
    return passes_sql(k, attempts) + """,
    g AS (SELECT * FROM b WHERE part = 1
      UNION ALL
      SELECT x.model, x.year, x.day, 2 AS part,
        CASE WHEN x.status = 'no_error' THEN y.kpass END AS kpass,
        CASE WHEN x.status = 'no_error' THEN y.status ELSE 'part1_failed' END AS status,
        CASE WHEN x.status = 'no_error' THEN y.row_no END AS row_no
      FROM (SELECT * FROM b WHERE part = 1) x LEFT JOIN (SELECT * FROM b WHERE part = 2) y
        ON x.model = y.model AND x.year = y.year AND x.day = y.day
      WHERE x.status IS DISTINCT FROM 'no_error' OR (y.row_no IS NOT NULL AND x.day <> 25))"""


_SHOWN = (
    "model, year, day, part, status, CAST(coalesce(kpass, -1) AS INTEGER) AS kpass, "
    "CAST(coalesce(row_no, -1) AS BIGINT) AS row_no"
)


def shown(results, *further):
    """Results with -1 for the absent pass and row number of a blocked part."""
    return results.select(
        "model",
        "year",
        "day",
        "part",
        "status",
        F.coalesce("kpass", F.lit(-1)).alias("kpass"),
        F.coalesce("row_no", F.lit(-1)).cast("long").alias("row_no"),
        *further,
    )


ACCURACY_COLUMNS = """count(*) AS total,
    count(*) FILTER (status = 'no_error') AS solved,
    count(*) FILTER (part = 1) AS total_part1, count(*) FILTER (part = 2) AS total_part2,
    count(*) FILTER (part = 1 AND status = 'no_error') AS solved_part1,
    count(*) FILTER (part = 2 AND status = 'no_error') AS solved_part2"""
ACCURACY_SHARES = """100.0::DOUBLE * solved / total AS accuracy,
    CASE WHEN total_part1 > 0 THEN 100.0::DOUBLE * solved_part1 / total_part1 END
      AS accuracy_part1,
    CASE WHEN total_part2 > 0 THEN 100.0::DOUBLE * solved_part2 / total_part2 END
      AS accuracy_part2"""


def _attempts(spark, folder):
    return V.ATTEMPTS.frame(spark, folder)


def _first_passes_sql(gate: str) -> str:
    """First passes ``f``; part 2 only for the days that ``gate`` lets through."""
    return f""",
    ok AS (SELECT DISTINCT model, year, day FROM {gate}),
    f AS (SELECT * FROM p WHERE kpass = 0 AND (part = 1 OR (day <> 25
          AND (model, year, day) IN (SELECT (model, year, day) FROM ok))))"""


GATE_K = "b WHERE part = 1 AND status = 'no_error'"
GATE_1 = "p WHERE part = 1 AND status = 'no_error' AND kpass = 0"

def _problem_passes(attempts: str) -> str:
    return f"""
    WITH a AS ({attempts}),
    p AS (SELECT model, id, kpass, arg_min(CASE WHEN provider_error IS NULL THEN status
            ELSE 'failed' END, row_no) AS status, min(row_no) AS row_no
          FROM a WHERE kpass < {K} GROUP BY model, id, kpass),
    e AS (SELECT *, coalesce(min(kpass) FILTER (status IN ('failed', 'no_error'))
            OVER (PARTITION BY model, id), max(kpass) OVER (PARTITION BY model, id)) AS chosen
          FROM p)"""


PROBLEM_PASSES = _problem_passes(V.CALLS.sql)
PROBLEM_LISTS = f""" SELECT model, id, kpass, status, row_no, {K} AS k,
        'euler' AS subset FROM e WHERE kpass = chosen AND status <> 'failed'
    UNION ALL SELECT model, id, kpass, status, row_no, 1 AS k, 'euler' AS subset FROM p
        WHERE kpass = 0 AND status <> 'failed'"""


def _evaluated(s, d):
    executions = V.TASK_RUNS.frame(s, d)
    attempts = graded_attempts(executions, V.REEXTRACTIONS.frame(s, d))
    return shown(two_part_results(attempts, K), "subset", "k")


def _graded_sql(runs: View, integer_guard: bool) -> str:
    """The runs with their status, and their output and error as the limit leaves them."""
    in_time = in_time_sql(runs.sql)
    return f"""SELECT t.* EXCLUDE (stdout), g.status, g.output FROM ({in_time}) t
        JOIN ({runs_sql(integer_guard, in_time)}) g ON t.row_no = g.row_no"""


def _exported(s, d):
    attempts = graded_attempts(V.TASK_RUNS.frame(s, d), V.REEXTRACTIONS.frame(s, d))
    results = two_part_results(attempts, K).where(F.col("k") == K)
    rows = with_texts(results, attempts, parts_as_rows(V.CHALLENGES.frame(s, d)))
    return shown(rows, "output", "expected_output", "error", "code")


def _exported_sql() -> str:
    graded = _graded_sql(V.TASK_RUNS, False)
    return gated_sql(K, graded) + f""", x AS ({graded}), c AS (
        SELECT year, day, 1 AS part, part1_solution AS solution FROM ({V.CHALLENGES.sql})
        UNION ALL SELECT year, day, 2, part2_solution FROM ({V.CHALLENGES.sql}))
        SELECT g.model, g.year, g.day, g.part, g.status,
            CAST(coalesce(g.kpass, -1) AS INTEGER) AS kpass,
            CAST(coalesce(g.row_no, -1) AS BIGINT) AS row_no, coalesce(x.output, '') AS output,
            c.solution AS expected_output, coalesce(x.stderr, '') AS error,
            coalesce(x.code, '') AS code
        FROM g LEFT JOIN x ON g.row_no = x.row_no LEFT JOIN c
            ON g.year = c.year AND g.day = c.day AND g.part = c.part"""


BUCKETS = 8


def _stored_gated(s, d):
    """Gated results with texts over a stored table of graded runs."""
    path = new_table_path(s, "attempts")
    attempts = graded_attempts(V.TASK_RUNS.frame(s, d), V.REEXTRACTIONS.frame(s, d))
    stored = write_attempts(attempts, path.rsplit("/", 1)[1].replace("-", "_"), path, BUCKETS)
    return shown(attach_texts(gate_parts(stored, K), stored, ["output", "stderr", "code"]), "output", "stderr", "code")


def _stored_gated_sql() -> str:
    graded = _graded_sql(V.TASK_RUNS, False)
    return gated_sql(K, graded) + f""", x AS (SELECT row_no AS text_row, output, stderr, code FROM ({graded}))
        SELECT {_SHOWN}, output, stderr, code FROM g LEFT JOIN x ON g.row_no = x.text_row"""


def _written_results(s, d):
    """Result rows with their texts, written as a table by subset and k and read again."""
    path = new_table_path(s, "result-rows")
    rows = _exported(s, d).withColumns({"subset": F.lit("aoc"), "k": F.lit(K)})
    write_results(rows, path)
    return s.read.parquet(path).select(*rows.columns)


def _problem_lists(s, d):
    attempts = graded_problems(V.PROBLEM_RUNS.frame(s, d), V.REEXTRACTIONS.frame(s, d))
    return attempts, problem_results(attempts, K)


def _exported_problems(s, d):
    attempts, results = _problem_lists(s, d)
    return with_problem_texts(results, attempts, V.PROBLEMS.frame(s, d))


def _exported_problems_sql() -> str:
    graded = _graded_sql(V.PROBLEM_RUNS, True)
    return _problem_passes(graded) + f""", r AS ({PROBLEM_LISTS}), x AS ({graded})
        SELECT r.model, r.id, r.status, coalesce(x.output, '') AS output,
            c.solution AS expected_output, coalesce(x.stderr, '') AS error,
            coalesce(x.code, '') AS code, c.difficulty, r.kpass, r.k, r.row_no
        FROM r LEFT JOIN x ON r.row_no = x.row_no LEFT JOIN ({V.PROBLEMS.sql}) c ON r.id = c.id"""


def lists_sql(attempts: str) -> str:
    """Both lists of a two-part run."""
    lists = gated_sql(K, attempts) + _first_passes_sql(GATE_K)
    return lists + f""" SELECT {_SHOWN}, 'aoc' AS subset, {K} AS k FROM g
        UNION ALL SELECT {_SHOWN}, 'aoc' AS subset, 1 AS k FROM f"""


def problem_lists_sql(attempts: str) -> str:
    """Both lists of a math run."""
    return _problem_passes(attempts) + PROBLEM_LISTS


QUERIES = [
    Query("stored_gated", _stored_gated, _stored_gated_sql()),
    Query(
        "write_results_texts",
        _written_results,
        f"SELECT *, 'aoc' AS subset, {K} AS k FROM ({_exported_sql()})",
    ),
    Query("evaluate_run", _evaluated, lists_sql(_graded_sql(V.TASK_RUNS, False))),
    Query("export_rows_t", _exported, _exported_sql()),
    Query(
        "evaluate_problem_runs",
        lambda s, d: _problem_lists(s, d)[1],
        problem_lists_sql(_graded_sql(V.PROBLEM_RUNS, True)),
    ),
    Query("export_rows_m", _exported_problems, _exported_problems_sql()),
    Query(
        "best_of_k_m",
        lambda s, d: best_of_k(V.CALLS.frame(s, d), K, PROBLEM_KEYS, failed_calls=True),
        PROBLEM_PASSES + """ SELECT model, id, kpass, status, row_no FROM e
        WHERE kpass = chosen AND status <> 'failed'""",
    ),
    Query(
        "evaluate_run_m",
        lambda s, d: problem_results(V.CALLS.frame(s, d), K),
        PROBLEM_PASSES + PROBLEM_LISTS,
    ),
    Query(
        "first_pass_m",
        lambda s, d: first_pass(V.CALLS.frame(s, d), PROBLEM_KEYS, failed_calls=True),
        PROBLEM_PASSES + """ SELECT model, id, kpass, status, row_no FROM p
        WHERE kpass = 0 AND status <> 'failed'""",
    ),
    Query(
        "first_pass",
        lambda s, d: shown(first_pass(_attempts(s, d))),
        passes_sql(1) + f" SELECT {_SHOWN} FROM p",
    ),
    Query(
        "first_pass_with_gaps",
        lambda s, d: shown(first_pass(_attempts(s, d), numbering="gaps")),
        passes_sql(1000)
        + f""", f AS (SELECT *, min(kpass) OVER (PARTITION BY {TASK}) AS low FROM p)
        SELECT {_SHOWN} FROM f WHERE kpass = low""",
    ),
    Query(
        "best_of_k",
        lambda s, d: shown(best_of_k(_attempts(s, d), K)),
        passes_sql() + f" SELECT {_SHOWN} FROM b",
    ),
    Query(
        "best_of_all",
        lambda s, d: shown(best_of_k(_attempts(s, d), 1000)),
        passes_sql(1000) + f" SELECT {_SHOWN} FROM b",
    ),
    Query(
        "best_of_40",
        lambda s, d: shown(best_of_k(V.OPEN_ATTEMPTS.frame(s, d), 40)),
        passes_sql(40, V.OPEN_ATTEMPTS.sql) + f" SELECT {_SHOWN} FROM b",
    ),
    Query(
        "part_gating_40",
        lambda s, d: shown(gate_parts(V.OPEN_ATTEMPTS.frame(s, d), 40)),
        gated_sql(40, V.OPEN_ATTEMPTS.sql) + f" SELECT {_SHOWN} FROM g",
    ),
    Query(
        "first_pass_gated_40",
        lambda s, d: shown(first_pass_gated(V.OPEN_ATTEMPTS.frame(s, d), 40)),
        passes_sql(40, V.OPEN_ATTEMPTS.sql) + _first_passes_sql(GATE_K) + f" SELECT {_SHOWN} FROM f",
    ),
    Query(
        "early_stop",
        lambda s, d: early_stop(_attempts(s, d)).select(
            "row_no",
            "model",
            "year",
            "day",
            "part",
            "kpass",
            "status",
            F.coalesce("stop_pass", F.lit(-1)).alias("stop_pass"),
        ),
        f"""WITH a AS ({V.ATTEMPTS.sql}), s AS (SELECT *, min(kpass)
            FILTER (status = 'no_error') OVER (PARTITION BY {TASK}) AS stop_at FROM a)
        SELECT row_no, model, year, day, part, kpass, status,
          CAST(coalesce(stop_at, -1) AS INTEGER) AS stop_pass
        FROM s WHERE stop_at IS NULL OR kpass <= stop_at""",
    ),
    Query(
        "part_gating",
        lambda s, d: shown(gate_parts(_attempts(s, d), K)),
        gated_sql() + f" SELECT {_SHOWN} FROM g",
    ),
    Query(
        "first_pass_gated",
        lambda s, d: shown(first_pass_gated(_attempts(s, d), K)),
        passes_sql() + _first_passes_sql(GATE_K) + f" SELECT {_SHOWN} FROM f",
    ),
    Query(
        "first_pass_gated_by_first",
        lambda s, d: shown(first_pass_gated(_attempts(s, d), K, gate="1")),
        passes_sql() + _first_passes_sql(GATE_1) + f" SELECT {_SHOWN} FROM f",
    ),
    Query(
        "best_of_k_accuracy",
        lambda s, d: best_of_k_accuracy(_attempts(s, d), K),
        gated_sql() + f""", c AS (SELECT model, {ACCURACY_COLUMNS} FROM g
            WHERE NOT (day = 25 AND part = 2) GROUP BY model)
        SELECT *, {ACCURACY_SHARES} FROM c""",
    ),
    Query(
        "ordered_tasks",
        lambda s, d: ordered_tasks(
            V.CHALLENGES.frame(s, d).select("year", "day", "part1_solution")
        ),
        f"SELECT year, day, part1_solution FROM ({V.CHALLENGES.sql}) ORDER BY year, day",
    ),
    Query(
        "dedup_first",
        lambda s, d: dedup_rows(V.RESULTS_MATH.frame(s, d), ["model", "id"], "first"),
        f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY model, id ORDER BY row_no) AS rn FROM ({V.RESULTS_MATH.sql}))
        WHERE rn = 1""",
    ),
    Query(
        "dedup_last",
        lambda s, d: dedup_rows(_attempts(s, d), ["model", *PART_KEYS], "last"),
        f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY {TASK} ORDER BY row_no DESC) AS rn FROM ({V.ATTEMPTS.sql}))
        WHERE rn = 1""",
    ),
    Query(
        "dedup_first_composite",
        lambda s, d: dedup_rows(_attempts(s, d), ["model", *PART_KEYS], "first"),
        f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY {TASK} ORDER BY row_no) AS rn FROM ({V.ATTEMPTS.sql}))
        WHERE rn = 1""",
    ),
]
