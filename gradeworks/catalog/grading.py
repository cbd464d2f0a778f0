"""Queries: code extraction, output normalization, grading of runs and answers."""

from pyspark.sql import functions as F

from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query
from gradeworks.functions import grading as GF
from gradeworks.functions.text import extract_code, is_integer_text, last_integer, python_strip
from gradeworks.operators import grading as G

KEY = ["row_no"]
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_FENCED = "regexp_extract_all({t}, '(?s)```{tag}(.*?)```', 1)"


def code_sql(text: str) -> str:
    tagged, plain = _FENCED.format(t=text, tag="python"), _FENCED.format(t=text, tag="")
    return (
        f"coalesce(CASE WHEN len({tagged}) > 0 THEN array_to_string({tagged}, chr(10)) "
        f"ELSE array_to_string({plain}, chr(10)) END, '')"
    )


_OUT = STRIP.format("stdout")
_ERROR_CLASS = """CASE WHEN contains(stderr, 'SyntaxError:') THEN 'syntax_error'
    WHEN contains(stderr, 'TIMEOUT') THEN 'timeout_error' ELSE 'runtime_error' END"""


def runs_sql(integer_guard: bool, runs: str = V.RUNS.sql) -> str:
    """Grades of the runs, joined to the re-extracted answers."""
    look = f"({_OUT} <> solution"
    look += f" AND NOT regexp_matches({_OUT}, '^[+-]?[0-9]+(_[0-9]+)*$'))" if integer_guard else ")"
    return f"""WITH r AS ({runs}), t AS ({V.REEXTRACTIONS.sql}),
    j AS (SELECT r.*, coalesce(t.text, {_OUT}) AS second FROM r
          LEFT JOIN t ON r.row_no = t.row_no),
    g AS (SELECT *, stderr = '' AND {look} AND {STRIP.format("second")} = solution AS ok2 FROM j)
    SELECT row_no, CASE WHEN stderr <> '' THEN {_ERROR_CLASS}
        WHEN {_OUT} = solution OR ok2 THEN 'no_error' ELSE 'wrong_output' END AS status,
        CASE WHEN ok2 THEN {STRIP.format("second")} ELSE stdout END AS output FROM g"""


def in_time_sql(runs: str) -> str:
    """The runs, those over the time limit as timeouts without output."""
    late = "(duration_s > 60)"
    return f"""SELECT * EXCLUDE (stdout, stderr), CASE WHEN {late} THEN '' ELSE stdout END
        AS stdout, CASE WHEN {late} THEN 'TIMEOUT' ELSE stderr END AS stderr FROM ({runs})"""


def _runs(s, d):
    return V.RUNS.frame(s, d)


def _texts(s, d):
    return V.REEXTRACTIONS.frame(s, d)


_ANSWER = STRIP.format("answer")
_DIRECT = f"""CASE WHEN regexp_matches(solution, '[1-9]') AND
    regexp_matches(solution, '^[+-]?[0-9]+(_[0-9]+)*$')
    THEN coalesce(list_last(regexp_extract_all({_ANSWER}, '[0-9]+')), {_ANSWER})
    ELSE {_ANSWER} END"""

QUERIES = [
    Query(
        "extract_code",
        lambda s, d: V.GENERATIONS.frame(s, d).select(
            "row_no", extract_code(F.col("response")).alias("code")
        ),
        f"SELECT row_no, {code_sql('response')} AS code FROM ({V.GENERATIONS.sql})",
    ),
    Query(
        "effective_code",
        lambda s, d: G.with_effective_code(V.SNIPPETS.frame(s, d)).select(
            "row_no", "code"
        ),
        f"""SELECT row_no, CASE form WHEN 2 THEN literal ELSE response END AS code
        FROM ({V.SNIPPETS.sql})""",
    ),
    Query(
        "syntax_triage",
        lambda s, d: G.syntax_rates(V.SNIPPETS.frame(s, d), ["model"]),
        f"""SELECT model, count(*) AS responses, count(*) FILTER (form = 0) AS valid
        FROM ({V.SNIPPETS.sql}) GROUP BY model""",
    ),
    Query(
        "normalize_output",
        lambda s, d: _runs(s, d).select("row_no", python_strip(F.col("stdout")).alias("output")),
        f"SELECT row_no, {_OUT} AS output FROM ({V.RUNS.sql})",
    ),
    Query(
        "classify_error",
        lambda s, d: _runs(s, d)
        .where("stderr <> ''")
        .select("row_no", GF.classify_error(F.col("stderr")).alias("status")),
        f"SELECT row_no, {_ERROR_CLASS} AS status FROM ({V.RUNS.sql}) WHERE stderr <> ''",
    ),
    Query(
        "exact_match",
        lambda s, d: _runs(s, d).select(
            "row_no", GF.matches(F.col("stdout"), F.col("solution")).alias("matches")
        ),
        f"SELECT row_no, {_OUT} = solution AS matches FROM ({V.RUNS.sql})",
    ),
    Query(
        "integer_guard",
        lambda s, d: _runs(s, d).select(
            "row_no", is_integer_text(F.col("stdout")).alias("is_integer")
        ),
        f"""SELECT row_no, regexp_matches({_OUT}, '^[+-]?[0-9]+(_[0-9]+)*$') AS is_integer
        FROM ({V.RUNS.sql})""",
    ),
    Query(
        "second_look_join",
        lambda s, d: G.second_look(
            G.with_printed(_runs(s, d)).where("is_open"), _texts(s, d), KEY
        ).select("row_no", "final_output"),
        f"""WITH r AS ({V.RUNS.sql}), t AS ({V.REEXTRACTIONS.sql})
        SELECT r.row_no, {STRIP.format("coalesce(t.text, stdout)")} AS final_output
        FROM r LEFT JOIN t ON r.row_no = t.row_no
        WHERE stderr = '' AND {_OUT} <> solution""",
    ),
    Query(
        "second_look_faults",
        lambda s, d: G.second_look_faults(
            _texts(s, d).union(_texts(s, d).where("row_no % 3 = 0")), KEY
        ),
        f"""SELECT row_no, CAST(2 AS BIGINT) AS rows FROM ({V.REEXTRACTIONS.sql}) WHERE row_no % 3 = 0""",
    ),
    Query(
        "last_integer",
        lambda s, d: V.ANSWERS.frame(s, d).select(
            "row_no",
            last_integer(F.col("answer")).alias("last_integer"),
            GF.direct_answer(F.col("answer"), F.col("solution")).alias("picked"),
        ),
        f"""SELECT row_no, coalesce(list_last(regexp_extract_all(answer, '[0-9]+')), '')
            AS last_integer, {_DIRECT} AS picked FROM ({V.ANSWERS.sql})""",
    ),
    Query(
        "grade_t",
        lambda s, d: G.grade_two_part(_runs(s, d), _texts(s, d), KEY).select(
            "row_no", "status", "output"
        ),
        runs_sql(False),
    ),
    Query(
        "grade_m",
        lambda s, d: G.grade_math(_runs(s, d), _texts(s, d), KEY).select(
            "row_no", "status", "output"
        ),
        runs_sql(True),
    ),
    Query(
        "grade_direct",
        lambda s, d: G.grade_direct(
            V.ANSWERS.frame(s, d), V.ANSWER_TEXTS.frame(s, d), KEY
        ).select("row_no", "status", "output"),
        f"""WITH a AS ({V.ANSWERS.sql}), t AS ({V.ANSWER_TEXTS.sql}),
        j AS (SELECT a.*, {_DIRECT} AS picked, t.text FROM a
              LEFT JOIN t ON a.row_no = t.row_no),
        g AS (SELECT *, picked <> solution
            AND NOT regexp_matches(picked, '^[+-]?[0-9]+(_[0-9]+)*$')
            AND {STRIP.format("coalesce(text, picked)")} = solution AS ok2 FROM j)
        SELECT row_no, CASE WHEN picked = solution OR ok2 THEN 'no_error'
            ELSE 'wrong_output' END AS status,
            CASE WHEN ok2 THEN {STRIP.format("coalesce(text, picked)")} ELSE answer END
            AS output FROM g""",
    ),
    Query(
        "provider_failures",
        lambda s, d: G.drop_after_provider_failure(
            V.CALLS.frame(s, d), ["model", "id"], F.col("row_no")
        ).select("row_no", "model", "id", "kpass", "response"),
        f"""SELECT row_no, model, id, kpass, response FROM (SELECT *, min(kpass) FILTER (
            provider_error IS NOT NULL) OVER (PARTITION BY model, id) AS failed_at
            FROM ({V.CALLS.sql})) WHERE failed_at IS NULL OR kpass < failed_at""",
    ),
    Query(
        "provider_failures_t",
        lambda s, d: G.provider_failures_as_text(V.CALLS.frame(s, d)).select(
            "row_no", "response"
        ),
        f"""SELECT row_no, CASE WHEN provider_error IS NULL THEN response
            ELSE concat('ProviderError: ', provider_error) END AS response
        FROM ({V.CALLS.sql})""",
    ),
    Query(
        "status_domain",
        lambda s, d: G.outside_status_domain(
            s.read.parquet(f"{d}/events.parquet").select(
                F.col("event_id").alias("row_no"),
                F.when(F.col("event_type") == "signup", "no_error")
                .when(F.col("event_type") != "view", F.col("event_type"))
                .alias("status"),
            )
        ).select("row_no", F.coalesce("status", F.lit("(none)")).alias("status")),
        """SELECT event_id AS row_no, CASE WHEN event_type = 'view' THEN '(none)'
            ELSE event_type END AS status FROM events WHERE event_type <> 'signup'""",
    ),
    Query(
        "ignore_warnings",
        lambda s, d: G.ignore_warnings(V.EXITED_RUNS.frame(s, d)).select("row_no", "stderr"),
        f"""SELECT row_no, CASE WHEN exit_code = 0 THEN '' ELSE stderr END AS stderr
        FROM ({V.EXITED_RUNS.sql})""",
    ),
    Query(
        "timeout_marker",
        lambda s, d: G.mark_timeouts(_runs(s, d)).select("row_no", "stdout", "stderr"),
        f"""SELECT row_no, CASE WHEN duration_s > 60 THEN '' ELSE stdout END AS stdout,
            CASE WHEN duration_s > 60 THEN 'TIMEOUT' ELSE stderr END AS stderr
        FROM ({V.RUNS.sql})""",
    ),
]
