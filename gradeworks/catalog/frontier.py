"""Queries: what a run has left to do, and the prompts for it."""

from pyspark.sql import functions as F

from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query
from gradeworks.catalog.passes import K, passes_sql
from gradeworks.catalog.texts import PART2_SQL, SYSTEM_SQL, math_prompt_sql
from gradeworks.functions.prompts import render_messages
from gradeworks.operators import frontier as R
from gradeworks.schemas import PROBLEM_KEYS
from gradeworks.session import new_table_path
from gradeworks.sources.snapshots import by_id_range, by_year

# What has come so far: the first pass of everything, later the other passes of these.
LATER = "year >= 2019"
LATER_IDS = "id >= 200"
LAST_ID = 499


def _due_prompts(s, d):
    """Attempts arrive in two lots; the second one touches the later years only, and repeats rows."""
    root = new_table_path(s, "frontier")
    attempts = V.ATTEMPTS.frame(s, d)
    for lot in (attempts.where("kpass = 0"), attempts.where(LATER)):
        R.merge_attempts(lot, root, by_year())
    challenges = V.CHALLENGES.frame(s, d).select("year", "day", F.col("part1").alias("description"))
    models = attempts.select("model").distinct()
    due = R.due_days(R.run_days(challenges, models), R.kept_passes(s, root), K)
    generations = V.TASK_RUNS.frame(s, d).select("row_no", F.col("code").alias("response"))
    prompts = R.due_prompts(due, challenges, generations)
    return prompts.withColumn("prompt", render_messages(F.col("messages"))).drop("messages")


def _due_prompts_sql() -> str:
    so_far = f"SELECT * FROM ({V.ATTEMPTS.sql}) WHERE kpass = 0 OR {LATER}"
    return passes_sql(K, so_far) + f""",
    t AS (SELECT model, year, day, part, bool_or(status = 'no_error') AS solved, max(kpass) AS last_pass,
            arg_min(row_no, kpass) FILTER (status = 'no_error') AS solved_row
          FROM p GROUP BY model, year, day, part),
    c AS (SELECT m.model, year, day, part1 FROM ({V.CHALLENGES.sql})
          JOIN (SELECT DISTINCT model FROM ({V.ATTEMPTS.sql})) m ON year BETWEEN 2015 AND 2022),
    n AS (SELECT c.*, coalesce(t1.solved, false) AS s1, coalesce(t2.solved, false) AS s2, t1.solved_row,
            coalesce(t1.last_pass + 1, 0) AS n1, coalesce(t2.last_pass + 1, 0) AS n2
          FROM c LEFT JOIN t t1 ON c.model = t1.model AND c.year = t1.year AND c.day = t1.day AND t1.part = 1
            LEFT JOIN t t2 ON c.model = t2.model AND c.year = t2.year AND c.day = t2.day AND t2.part = 2)
    SELECT model, year, day, 1 AS part, CAST(n1 AS INTEGER) AS kpass,
        concat('system: ', {SYSTEM_SQL}, chr(10), 'human: ', part1) AS prompt
    FROM n WHERE NOT s1 AND n1 < {K}
    UNION ALL SELECT n.model, n.year, n.day, 2, CAST(n2 AS INTEGER), concat('system: ', {SYSTEM_SQL}, chr(10),
        'human: ', part1, chr(10), 'ai: ', r.code, chr(10), 'human: ', {PART2_SQL})
    FROM n JOIN ({V.TASK_RUNS.sql}) r ON n.solved_row = r.row_no
    WHERE s1 AND n.day <> 25 AND NOT s2 AND n2 < {K}"""


def _due_prompts_m(s, d):
    root = new_table_path(s, "frontier-m")
    calls = V.CALLS.frame(s, d)
    for lot in (calls.where("kpass = 0"), calls.where(LATER_IDS)):
        R.merge_attempts(lot, root, by_id_range(100), PROBLEM_KEYS, failed_calls=True)
    models = calls.select("model").distinct().select("model", F.lit(0).alias("first_id"), F.lit(LAST_ID).alias("last_id"))
    problems = V.PROBLEMS.frame(s, d).select("id", "title", F.col("problem").alias("description"))
    return R.due_problems(problems, models, R.kept_passes(s, root, PROBLEM_KEYS), K)


QUERIES = [
    Query("due_prompts", _due_prompts, _due_prompts_sql()),
    Query(
        "due_prompts_m",
        _due_prompts_m,
        f"""WITH a AS (SELECT * FROM ({V.CALLS.sql}) WHERE (kpass = 0 OR {LATER_IDS}) AND kpass < {K}),
        p AS (SELECT model, id, kpass, arg_min(CASE WHEN provider_error IS NULL THEN status ELSE 'failed' END,
                row_no) AS status FROM a GROUP BY model, id, kpass),
        t AS (SELECT model, id, max(kpass) AS last_pass, bool_or(status IN ('no_error', 'failed')) AS ended
              FROM p GROUP BY model, id),
        m AS (SELECT DISTINCT model FROM ({V.CALLS.sql}))
        SELECT m.model, c.id, CAST(coalesce(last_pass + 1, 0) AS INTEGER) AS kpass,
            {math_prompt_sql('title', 'problem')} AS prompt
        FROM ({V.PROBLEMS.sql}) c JOIN m ON c.id BETWEEN 0 AND {LAST_ID}
        LEFT JOIN t ON m.model = t.model AND c.id = t.id
        WHERE NOT coalesce(ended, false) AND coalesce(last_pass + 1, 0) < {K}""",
    ),
]
