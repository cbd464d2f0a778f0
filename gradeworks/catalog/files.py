"""Queries that write a derived table in a file format and read it back, and streams."""

from pyspark.sql import functions as F

from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query
from gradeworks.catalog.grading import in_time_sql, runs_sql
from gradeworks.catalog.passes import (
    ACCURACY_COLUMNS,
    ACCURACY_SHARES,
    K,
    lists_sql,
    passes_sql,
    problem_lists_sql,
    gated_sql,
    shown,
)
from gradeworks.catalog.tasks import FLAT, nested
from gradeworks.fixed_values import TWO_PART
from gradeworks.operators.passes import best_of_k, first_pass
from gradeworks.operators.tasks import resume_days
from gradeworks.plans.evaluation import problem_results, two_part_results
from gradeworks.schemas import RESULT_LIST_MATH, RESULT_LIST_TWO_PART
from gradeworks.session import new_table_path
from gradeworks.sources import corpus as C
from gradeworks.sources import results as S
from gradeworks.sources import writers as W
from gradeworks.sources.snapshots import by_id_range, by_year, read_snapshot, save_snapshot
from gradeworks.streaming.grading import Patience, closing_rows, start_grading, start_joined_grading
from gradeworks.streaming.leaderboard import read_leaderboard, start_leaderboard

RESULT_COLUMNS = ["row_no", "year", "day", "part", "status", "output", "expected_output"]


def _read_challenges(s, d):
    path = new_table_path(s, "challenges")
    W.write_challenges(nested(s, d), path)
    return C.read_challenges(s, path, one_file_per_day=False)


def _quarantine(s, d):
    """Challenge records of one language lose their last character on the way."""
    path = new_table_path(s, "challenge-lines")
    lines = s.read.parquet(f"{d}/documents.parquet").select(
        F.to_json(
            F.struct(
                F.expr(V.CHALLENGES.columns["year"]).alias("year"),
                F.expr(V.CHALLENGES.columns["day"]).alias("day"),
                F.col("text").alias("input"),
            )
        ).alias("json"),
        "lang",
    )
    cut = F.left("json", F.length("json") - 1)
    lines.select(F.when(F.col("lang") == "es", cut).otherwise(F.col("json"))).write.text(path)
    records = C.read_nested_challenges(s, path, one_file_per_day=False)
    good = F.col(C.CORRUPT).isNull()
    return records.groupBy(good.alias("parsed")).agg(
        F.count("*").alias("records"),
        F.sum(F.when(good, F.length("input")).otherwise(0)).alias("input_chars"),
    )


def _read_problems(s, d):
    path = new_table_path(s, "problems")
    V.PROBLEMS.frame(s, d).write.json(path)
    return C.read_problems(s, path, one_array_per_file=False)


def _export(s, d):
    path = new_table_path(s, "export")
    W.write_export(V.CHALLENGES.frame(s, d), path)
    return C.read_export(s, path, TWO_PART)


def _read_results(s, d):
    path = new_table_path(s, "results")
    W.export_results(V.RESULT_CSV.frame(s, d), path)
    return S.read_results(s, path, TWO_PART).select(
        *RESULT_COLUMNS,
        F.coalesce("error", F.lit("")).alias("error"),
        "code",
        F.coalesce("kpass", F.lit(-1)).alias("kpass"),
    )


def _named_results(s, d):
    rows = V.RESULT_FILES.frame(s, d)
    return S.parse_result_name(rows.where(S.is_result_file(F.col("path"))))


def _write_results(s, d):
    path = new_table_path(s, "result-table")
    W.write_results(_named_results(s, d).select("row_no", "model", "status", "subset", "k"), path)
    return s.read.parquet(path).select("row_no", "model", "status", "subset", "k")


def _snapshot(s, d):
    """First-pass results of all years, then best-of-3 results of the later ones."""
    path = new_table_path(s, "snapshot")
    attempts = V.ATTEMPTS.frame(s, d)
    columns = ["model", "year", "day", "part", "kpass", "status"]
    W.write_snapshot(first_pass(attempts).select(*columns), path)
    W.write_snapshot(best_of_k(attempts, 3).where("year >= 2019").select(*columns), path)
    return s.read.parquet(path).select(*columns)


def _stream_grade(s, d):
    path = new_table_path(s, "graded")
    runs = V.RUNS_WITH_TEXT.stream(s, d)
    start_grading(runs, path, new_table_path(s, "graded-checkpoint")).awaitTermination()
    return s.read.parquet(path).select("row_no", "status", "output")


def _stream_leaderboard(s, d):
    path = new_table_path(s, "leaderboard")
    checkpoint = new_table_path(s, "leaderboard-checkpoint")
    start_leaderboard(V.ATTEMPTS.stream(s, d), 3, path, checkpoint).awaitTermination()
    return read_leaderboard(s, path)


ARRIVALS, LAG = 2, 2


def _stream_grade_joined(s, d):
    """Runs and re-extracted answers in files of their own; an answer comes LAG files after its run."""
    root = new_table_path(s, "joined-grading")
    runs, answers = V.TIMED_RUNS.frame(s, d), V.TIMED_ANSWERS.frame(s, d)
    low, high = (x.timestamp() if x else 0.0 for x in runs.agg(F.min("ended_at"), F.max("ended_at")).first())
    width = (high - low) / ARRIVALS + 1
    lag = F.make_dt_interval(secs=F.lit(LAG * width))
    arrivals = {
        "runs": (runs, "ended_at", 0),
        "answers": (answers.withColumn("answered_at", F.col("asked_at") + lag).drop("asked_at"), "answered_at", LAG),
    }
    patience = Patience(f"{int(LAG * width) + 60} seconds", "1 minute")
    for turn in range(ARRIVALS + LAG):
        for name, (rows, time, _) in arrivals.items():
            place = F.floor((F.unix_micros(time) / 1e6 - low) / width)
            rows.where(place == turn).write.mode("append").parquet(f"{root}/{name}")
            if turn == ARRIVALS + LAG - 1:
                end = F.timestamp_seconds(F.lit(high + 4 * LAG * width + 600))
                closing_rows(s, time, rows, end).write.mode("append").parquet(f"{root}/{name}")
        streams = [s.readStream.schema(rows.schema).parquet(f"{root}/{name}") for name, (rows, _, _) in arrivals.items()]
        start_joined_grading(*streams, f"{root}/graded", f"{root}/checkpoint", patience).awaitTermination()
    return s.read.parquet(f"{root}/graded").select("row_no", "status", "output")


def _stream_leaderboard_files(s, d):
    """Attempts in six files in no order, one of them delivered twice."""
    root = new_table_path(s, "leaderboard-files")
    attempts = V.ATTEMPTS.frame(s, d)
    shuffled = attempts.repartition(6, F.xxhash64("row_no"))
    shuffled.write.parquet(f"{root}/attempts")
    again = attempts.where(F.pmod(F.xxhash64("row_no"), F.lit(6)) == 0)
    again.repartition(1).write.mode("append").parquet(f"{root}/attempts")
    arriving = s.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/attempts")
    start_leaderboard(arriving, K, f"{root}/report", f"{root}/checkpoint").awaitTermination()
    return read_leaderboard(s, f"{root}/report")


LATER_YEARS = "year >= 2019"
LATER_IDS = "id >= 200"


def _snapshot_t(s, d):
    """Snapshot after the first pass of every year, then after all passes of the later years."""
    root = new_table_path(s, "snapshot-t")
    attempts = V.ATTEMPTS.frame(s, d)
    for so_far in (attempts.where("kpass = 0"), attempts.where(LATER_YEARS)):
        save_snapshot(two_part_results(so_far, K), root, by_year())
    return shown(read_snapshot(s, root, RESULT_LIST_TWO_PART), "subset", "k")


def _snapshot_m(s, d):
    """The same for problems in ranges of a hundred ids."""
    root = new_table_path(s, "snapshot-m")
    calls = V.CALLS.frame(s, d)
    for so_far, covered in ((calls.where("kpass = 0"), None), (calls.where(LATER_IDS), [2, 3, 4])):
        save_snapshot(problem_results(so_far, K), root, by_id_range(100), covered)
    return read_snapshot(s, root, RESULT_LIST_MATH)


def _resume_from_snapshot(s, d):
    """Challenges still to run after a snapshot: their day lacks a part that is due."""
    root = new_table_path(s, "snapshot-resume")
    save_snapshot(two_part_results(V.ATTEMPTS.frame(s, d), K), root, by_year())
    results = read_snapshot(s, root, RESULT_LIST_TWO_PART).where(F.col("k") == K)
    solved = results.where("status = 'no_error'")
    challenges = V.CHALLENGES.frame(s, d).select("year", "day", "part1_solution")
    return resume_days(challenges, solved, count_final_day=True)


def _both(first: str, second: str) -> str:
    return f"SELECT * FROM ({first}) UNION ALL SELECT * FROM ({second})"


_FIRST_CALLS = f"SELECT * FROM ({V.CALLS.sql}) WHERE kpass = 0"
_FIRST_ATTEMPTS = f"SELECT * FROM ({V.ATTEMPTS.sql}) WHERE kpass = 0"

QUERIES = [
    Query(
        "stream_grade_joined",
        _stream_grade_joined,
        runs_sql(False, in_time_sql(V.RUNS.sql)),
    ),
    Query(
        "stream_leaderboard_files",
        _stream_leaderboard_files,
        gated_sql() + f""", c AS (SELECT model, {ACCURACY_COLUMNS} FROM g
            WHERE NOT (day = 25 AND part = 2) GROUP BY model)
        SELECT *, {ACCURACY_SHARES} FROM c""",
    ),
    Query(
        "snapshot_t",
        _snapshot_t,
        _both(
            lists_sql(f"{_FIRST_ATTEMPTS} AND NOT ({LATER_YEARS})"),
            lists_sql(f"SELECT * FROM ({V.ATTEMPTS.sql}) WHERE {LATER_YEARS}"),
        ),
    ),
    Query(
        "snapshot_m",
        _snapshot_m,
        _both(
            problem_lists_sql(f"{_FIRST_CALLS} AND NOT ({LATER_IDS})"),
            problem_lists_sql(f"SELECT * FROM ({V.CALLS.sql}) WHERE {LATER_IDS}"),
        ),
    ),
    Query(
        "resume_from_snapshot",
        _resume_from_snapshot,
        gated_sql() + f""", done AS (SELECT year, day FROM g WHERE status = 'no_error' GROUP BY year, day
            HAVING count(*) FILTER (part = 1) > 0 AND (day = 25 OR count(*) FILTER (part = 2) > 0))
        SELECT year, day, part1_solution FROM ({V.CHALLENGES.sql}) c WHERE NOT EXISTS (
            SELECT 1 FROM done WHERE done.year = c.year AND done.day = c.day)""",
    ),
    Query("read_challenges", _read_challenges, f"SELECT {FLAT} FROM ({V.CHALLENGES.sql})"),
    Query(
        "quarantine",
        _quarantine,
        """SELECT lang <> 'es' AS parsed, count(*) AS records, CAST(sum(CASE WHEN lang <> 'es'
            THEN length(text) ELSE 0 END) AS BIGINT) AS input_chars
        FROM documents GROUP BY lang <> 'es'""",
    ),
    Query(
        "read_problems",
        _read_problems,
        f"""SELECT id, title, problem, difficulty, solution, story AS story_problem
        FROM ({V.PROBLEMS.sql})""",
    ),
    Query("export_roundtrip", _export, f"SELECT {FLAT} FROM ({V.CHALLENGES.sql})"),
    Query(
        "read_results",
        _read_results,
        f"""SELECT {", ".join(RESULT_COLUMNS)}, coalesce(error, '') AS error, code,
            CAST(coalesce(kpass, -1) AS INTEGER) AS kpass FROM ({V.RESULT_CSV.sql})""",
    ),
    Query(
        "write_results",
        _write_results,
        f"""SELECT row_no, regexp_extract(path, '([^/]*)-([^-]*)-pass', 1) AS model, status,
            CASE WHEN id IS NULL THEN 'aoc' ELSE 'euler' END AS subset,
            CAST(regexp_extract(path, '@(.)', 1) AS INTEGER) AS k
        FROM ({V.RESULT_FILES.sql}) WHERE NOT contains(path, '/old-')""",
    ),
    Query(
        "snapshot_by_year",
        _snapshot,
        passes_sql() + """ SELECT model, year, day, part, kpass, status FROM p
            WHERE kpass = 0 AND year < 2019
        UNION ALL SELECT model, year, day, part, kpass, status FROM b WHERE year >= 2019""",
    ),
    Query(
        "stream_grade",
        _stream_grade,
        runs_sql(False, in_time_sql(V.RUNS.sql)),
    ),
    Query(
        "stream_leaderboard",
        _stream_leaderboard,
        gated_sql() + f""", c AS (SELECT model, {ACCURACY_COLUMNS} FROM g
            WHERE NOT (day = 25 AND part = 2) GROUP BY model)
        SELECT *, {ACCURACY_SHARES} FROM c""",
    ),
]
