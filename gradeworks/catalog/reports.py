"""Queries: accuracy, leaderboards, day curves, error reports and lint findings."""

from pyspark.sql import functions as F

from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query
from gradeworks.catalog.passes import ACCURACY_COLUMNS, ACCURACY_SHARES, TASK
from gradeworks.functions.numbers import two_decimals
from gradeworks.functions.text import line_count
from gradeworks.operators import reports as R
from gradeworks.operators.findings import findings_summary
from gradeworks.operators.tasks import failures_only
from gradeworks.plans.leaderboard import error_report
from gradeworks.sources.results import model_alias, parse_result_name, report_files

LAST_COPY = f"""WITH a AS ({V.ATTEMPTS.sql}), l AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY {TASK} ORDER BY row_no DESC) AS rn FROM a WHERE NOT (day = 25 AND part = 2))
    WHERE rn = 1)"""
FIRST_COPY_MATH = f"""WITH a AS ({V.RESULTS_MATH.sql}), l AS (SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY model, id ORDER BY row_no) AS rn FROM a) WHERE rn = 1)"""

_NAME = r"(?:^|/)([^/-]+)-([^/-]+)-[^/@-]*@([^/@-]*)\.csv$"
NAMED = f"""WITH f AS ({V.RESULT_FILES.sql}),
    n AS (SELECT *, regexp_extract(path, '{_NAME}', 1) AS m,
        regexp_extract(path, '{_NAME}', 2) AS sub,
        regexp_extract(path, '{_NAME}', 3) AS kk FROM f),
    v AS (SELECT * EXCLUDE (m, sub, kk), m AS model, split_part(sub, '_', 1) AS subset,
        CASE WHEN NOT contains(sub, '_') THEN 'original'
             WHEN starts_with(sub, 'aoc') THEN 'leet' ELSE 'story' END AS variant,
        CAST(kk AS INTEGER) AS k FROM n WHERE m <> '')"""
CUBE = NAMED + """,
    d AS (SELECT *, row_number() OVER (PARTITION BY path, year, day, part, id ORDER BY
            CASE WHEN id IS NULL THEN -row_no ELSE row_no END) AS rn
          FROM v WHERE id IS NOT NULL OR NOT (day = 25 AND part = 2)),
    fc AS (SELECT path, model, subset, variant, k, count(*) AS total,
            count(*) FILTER (status = 'no_error') AS solved
          FROM d WHERE rn = 1 GROUP BY path, model, subset, variant, k),
    c AS (SELECT model, subset, variant, k, arg_max(total, path) AS total,
            arg_max(solved, path) AS solved FROM fc GROUP BY model, subset, variant, k),
    cube AS (SELECT *, 100.0::DOUBLE * solved / total AS accuracy FROM c)"""

_CELLS = [(s, v, k) for s, v in R.SCORE_CELLS for k in (1, 3)]
_PIVOT = ", ".join(
    f"max(accuracy) FILTER (subset = '{s}' AND variant = '{v}' AND k = {k}) "
    f"AS {R.cell_name(s, v, k)}"
    for s, v, k in _CELLS
)
_SCORES = ", ".join(
    f"max(accuracy) FILTER (subset = '{s}' AND variant = '{v}' AND k = 3) AS c{i}"
    for i, (s, v) in enumerate(R.SCORE_CELLS)
)

SHARES = f"""WITH a AS ({V.ATTEMPTS.sql}), l AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY {TASK} ORDER BY row_no) AS rn FROM a) WHERE rn = 1),
    e AS (SELECT model,
        count(*) FILTER (status NOT IN ('no_error', 'part1_failed')) AS total_errors,
        count(*) FILTER (status = 'syntax_error') AS s,
        count(*) FILTER (status = 'runtime_error') AS r,
        count(*) FILTER (status = 'timeout_error') AS t,
        count(*) FILTER (status = 'wrong_output') AS w FROM l GROUP BY model),
    x AS (SELECT model, total_errors, s::DOUBLE / total_errors AS syntax_errors,
        r::DOUBLE / total_errors AS runtime_errors,
        t::DOUBLE / total_errors AS timeout_errors,
        w::DOUBLE / total_errors AS wrong_outputs FROM e)"""
_CLASSES = ["syntax_errors", "runtime_errors", "timeout_errors", "wrong_outputs"]
_PCT = ", ".join(f"round_even({c} * 100 * 10, 0) / 10 AS {c}" for c in _CLASSES)
_BUCKETS = ", ".join(f"CAST(floor({c} / 5) AS INTEGER) AS {c}_bucket" for c in _CLASSES)


def _attempts(s, d):
    return V.ATTEMPTS.frame(s, d)


def _cube(s, d):
    return R.accuracy_cube(V.RESULT_FILES.frame(s, d))


def _shares(s, d):
    return R.error_shares(_attempts(s, d), ["model"])


def _percentages(s, d):
    return R.error_percentages(_shares(s, d), ["model"])


def _report_rows(s, d):
    return report_files(V.RESULT_FILES.frame(s, d))


def _findings(s, d):
    lines = V.SNIPPET_LINES.frame(s, d)
    snippets = lines.select(
        "model", "snippet_id", line_count(F.col("text")).cast("long").alias("code_lines")
    )
    return findings_summary(V.FINDINGS.frame(s, d), snippets)


QUERIES = [
    Query(
        "status_counts",
        lambda s, d: R.status_counts(_attempts(s, d), ["model"]),
        LAST_COPY + """ SELECT model, count(*) FILTER (status = 'syntax_error') AS syntax_error,
            count(*) FILTER (status = 'runtime_error') AS runtime_error,
            count(*) FILTER (status = 'wrong_output') AS wrong_output,
            count(*) FILTER (status = 'timeout_error') AS timeout_error,
            count(*) FILTER (status = 'part1_failed') AS part1_failed
        FROM l GROUP BY model""",
    ),
    Query(
        "status_counts_m",
        lambda s, d: R.status_counts(V.RESULTS_MATH.frame(s, d), ["model"]),
        FIRST_COPY_MATH + """ SELECT model,
            count(*) FILTER (status = 'syntax_error') AS syntax_error,
            count(*) FILTER (status = 'runtime_error') AS runtime_error,
            count(*) FILTER (status = 'wrong_output') AS wrong_output,
            count(*) FILTER (status = 'timeout_error') AS timeout_error
        FROM l GROUP BY model""",
    ),
    Query(
        "accuracy_m",
        lambda s, d: R.accuracy_math(V.RESULTS_MATH.frame(s, d), ["model"]),
        FIRST_COPY_MATH + """, c AS (SELECT model, count(*) AS total,
            count(*) FILTER (status = 'no_error') AS solved FROM l GROUP BY model)
        SELECT *, 100.0::DOUBLE * solved / total AS accuracy FROM c""",
    ),
    Query(
        "accuracy_t",
        lambda s, d: R.accuracy_two_part(_attempts(s, d), ["model"]),
        LAST_COPY + f""", c AS (SELECT model, {ACCURACY_COLUMNS} FROM l GROUP BY model)
        SELECT *, {ACCURACY_SHARES} FROM c""",
    ),
    Query(
        "accuracy_text",
        lambda s, d: R.accuracy_two_part(_attempts(s, d), ["model"]).select(
            "model", two_decimals(F.col("accuracy")).alias("accuracy")
        ),
        LAST_COPY + f""", c AS (SELECT model, {ACCURACY_COLUMNS} FROM l GROUP BY model),
            q AS (SELECT *, {ACCURACY_SHARES} FROM c)
        SELECT model, format('{{:.2f}}', accuracy) AS accuracy FROM q""",
    ),
    Query(
        "solved_by_day",
        lambda s, d: R.solved_by_day(_attempts(s, d)),
        f"""WITH a AS ({V.ATTEMPTS.sql}),
            days AS (SELECT CAST(range AS INTEGER) AS day FROM range(1, 25))
        SELECT days.day, count(*) FILTER (part = 1 AND status = 'no_error') AS part1_solved,
            count(*) FILTER (part = 2 AND status = 'no_error') AS part2_solved
        FROM days LEFT JOIN a ON a.day = days.day GROUP BY days.day""",
    ),
    Query(
        "solved_by_day_model",
        lambda s, d: R.solved_by_day_series(
            V.RESULT_FILES.frame(s, d).where("year IS NOT NULL"), "path"
        ),
        f"""WITH a AS (SELECT * FROM ({V.RESULT_FILES.sql}) WHERE year IS NOT NULL),
            s AS (SELECT DISTINCT path FROM a),
            days AS (SELECT CAST(range AS INTEGER) AS day FROM range(1, 25))
        SELECT replace(split_part(s.path, '/', -1), '.csv', '') AS series, days.day,
            count(*) FILTER (a.status = 'no_error') AS solved
        FROM s CROSS JOIN days LEFT JOIN a ON a.path = s.path AND a.day = days.day
        GROUP BY s.path, days.day""",
    ),
    Query(
        "parse_result_names",
        lambda s, d: parse_result_name(V.RESULT_FILES.frame(s, d).select("path").distinct())
        .select(
            "path",
            F.coalesce("model", F.lit("")).alias("model"),
            F.coalesce("subset", F.lit("")).alias("subset"),
            F.coalesce("variant", F.lit("")).alias("variant"),
            F.coalesce("k", F.lit(-1)).alias("k"),
        ),
        NAMED + """ SELECT DISTINCT f.path, coalesce(v.model, '') AS model,
            coalesce(v.subset, '') AS subset, coalesce(v.variant, '') AS variant,
            CAST(coalesce(v.k, -1) AS INTEGER) AS k
        FROM f LEFT JOIN v ON f.row_no = v.row_no""",
    ),
    Query(
        "model_alias",
        lambda s, d: V.FOLDERS.frame(s, d)
        .distinct()
        .select("folder", model_alias(F.col("folder")).alias("model")),
        f"""SELECT DISTINCT folder, CASE WHEN contains(folder, 'gpt') THEN 'gpt3.5'
            ELSE replace(folder, '-', '_') END AS model FROM ({V.FOLDERS.sql})""",
    ),
    Query(
        "accuracy_cube",
        _cube,
        CUBE + " SELECT model, subset, variant, k, total, solved, accuracy FROM cube",
    ),
    Query(
        "accuracy_rollup",
        lambda s, d: R.accuracy_rollup(_cube(s, d)),
        CUBE + """, t AS (SELECT model, subset, variant, k, sum(total)::BIGINT AS total,
            sum(solved)::BIGINT AS solved, GROUPING(model, subset, variant, k)::BIGINT AS level FROM cube
            GROUP BY GROUPING SETS ((model, subset, variant, k), (model, k), (subset, variant, k), (k)))
        SELECT *, 100.0::DOUBLE * solved / total AS accuracy FROM t""",
    ),
    Query(
        "error_rollup",
        lambda s, d: R.error_rollup(report_files(R.error_counts(V.RESULT_FILES.frame(s, d), ["path"]), "path")),
        f"""WITH f AS ({V.RESULT_FILES.sql}),
            l AS (SELECT *, row_number() OVER (PARTITION BY path, year, day, part, id
                ORDER BY row_no) AS rn FROM f),
            m(subset) AS (VALUES ('aoc'), ('aoc_converted'), ('euler'), ('euler_stories')),
            e AS (SELECT split_part(path, '/', -2) AS model, subset, status FROM l
                JOIN m ON split_part(path, '/', -1) = concat(
                    CASE WHEN contains(split_part(path, '/', -2), 'gpt') THEN 'gpt3.5'
                    ELSE replace(split_part(path, '/', -2), '-', '_') END, '-', subset, '-pass@3.csv')
                WHERE rn = 1),
            t AS (SELECT model, subset, GROUPING(model, subset)::BIGINT AS level,
                count(*) FILTER (status NOT IN ('no_error', 'part1_failed')) AS total_errors,
                count(*) FILTER (status = 'syntax_error') AS s,
                count(*) FILTER (status = 'runtime_error') AS r,
                count(*) FILTER (status = 'timeout_error') AS t,
                count(*) FILTER (status = 'wrong_output') AS w
                FROM e GROUP BY GROUPING SETS ((model, subset), (model), (subset), ()))
        SELECT model, subset, level, total_errors, s::DOUBLE / total_errors AS syntax_errors,
            r::DOUBLE / total_errors AS runtime_errors, t::DOUBLE / total_errors AS timeout_errors,
            w::DOUBLE / total_errors AS wrong_outputs FROM t""",
    ),
    Query(
        "leaderboard_pivot",
        lambda s, d: R.leaderboard(_cube(s, d)),
        CUBE + f" SELECT replace(model, '_', '-') AS model, {_PIVOT} FROM cube GROUP BY 1",
    ),
    Query(
        "overall_score",
        lambda s, d: R.overall_score(_cube(s, d)),
        CUBE + f""", w AS (SELECT model, {_SCORES} FROM cube GROUP BY model),
            z AS (SELECT model, (c0 IS NOT NULL)::INTEGER + (c1 IS NOT NULL)::INTEGER
                + (c2 IS NOT NULL)::INTEGER + (c3 IS NOT NULL)::INTEGER AS cells,
                coalesce(c0, 0) + coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0) AS t
                FROM w),
            q AS (SELECT model, cells, t / cells AS score, cells < 4 AS incomplete FROM z)
        SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM q""",
    ),
    Query(
        "failures_only",
        lambda s, d: failures_only(V.OPEN_ATTEMPTS.frame(s, d)),
        f"""SELECT * FROM ({V.OPEN_ATTEMPTS.sql})
        WHERE status IS NULL OR status NOT IN ('no_error', 'part1_failed')""",
    ),
    Query(
        "error_shares",
        _shares,
        SHARES + " SELECT * FROM x",
    ),
    Query(
        "error_pct",
        _percentages,
        SHARES + f" SELECT model, {_PCT}, total_errors FROM x",
    ),
    Query(
        "error_bucket",
        lambda s, d: R.error_buckets(_percentages(s, d)),
        SHARES + f""", q AS (SELECT model, {_PCT}, total_errors FROM x)
        SELECT *, {_BUCKETS} FROM q""",
    ),
    Query(
        "label_map",
        lambda s, d: R.with_subset_label(_report_rows(s, d))
        .groupBy("model", "subset", "label")
        .agg(F.count("*").alias("rows")),
        f"""WITH f AS ({V.RESULT_FILES.sql}), p AS (SELECT split_part(path, '/', -2) AS model,
            split_part(path, '/', -1) AS name FROM f),
            m(subset, label) AS (VALUES ('aoc', 'AoC'), ('aoc_converted', 'AoC-Leet'),
                ('euler', 'Euler'), ('euler_stories', 'Euler-Stories'))
        SELECT model, subset, label, count(*) AS rows FROM p JOIN m ON name = concat(
            CASE WHEN contains(model, 'gpt') THEN 'gpt3.5' ELSE replace(model, '-', '_') END,
            '-', subset, '-pass@3.csv') GROUP BY model, subset, label""",
    ),
    Query(
        "unlabelled_subsets",
        lambda s, d: R.without_subset_label(V.RESULT_FILES.frame(s, d).select("row_no", F.col("status").alias("subset")).union(
            _report_rows(s, d).select("row_no", "subset"))),
        f"SELECT row_no, status AS subset FROM ({V.RESULT_FILES.sql})",
    ),
    Query(
        "error_report",
        lambda s, d: error_report(V.RESULT_FILES.frame(s, d)),
        f"""WITH f AS ({V.RESULT_FILES.sql}),
            l AS (SELECT *, row_number() OVER (PARTITION BY path, year, day, part, id
                ORDER BY row_no) AS rn FROM f),
            e AS (SELECT path, count(*) AS total_errors,
                count(*) FILTER (status = 'syntax_error') AS s,
                count(*) FILTER (status = 'runtime_error') AS r,
                count(*) FILTER (status = 'timeout_error') AS t,
                count(*) FILTER (status = 'wrong_output') AS w
                FROM l WHERE rn = 1 AND status NOT IN ('no_error', 'part1_failed')
                GROUP BY path),
            m(subset, label) AS (VALUES ('aoc', 'AoC'), ('aoc_converted', 'AoC-Leet'),
                ('euler', 'Euler'), ('euler_stories', 'Euler-Stories')),
            x AS (SELECT split_part(path, '/', -2) AS model, subset, label, total_errors,
                s::DOUBLE / total_errors AS syntax_errors,
                r::DOUBLE / total_errors AS runtime_errors,
                t::DOUBLE / total_errors AS timeout_errors,
                w::DOUBLE / total_errors AS wrong_outputs
                FROM e JOIN m ON split_part(path, '/', -1) = concat(
                    CASE WHEN contains(split_part(path, '/', -2), 'gpt') THEN 'gpt3.5'
                    ELSE replace(split_part(path, '/', -2), '-', '_') END,
                    '-', subset, '-pass@3.csv')),
            q AS (SELECT model, subset, label, {_PCT}, total_errors FROM x)
        SELECT *, {_BUCKETS} FROM q""",
    ),
    Query(
        "distinct_status",
        lambda s, d: R.distinct_statuses(_attempts(s, d)),
        f"SELECT DISTINCT status FROM ({V.ATTEMPTS.sql})",
    ),
    Query(
        "findings_summary",
        _findings,
        f"""WITH f AS ({V.FINDINGS.sql}), s AS (SELECT model, snippet_id,
            length(text) - length(replace(text, chr(10), ''))
              + CASE WHEN text = '' OR text[-1] = chr(10) THEN 0 ELSE 1 END AS n
              FROM ({V.SNIPPET_LINES.sql})),
            p AS (SELECT model, snippet_id, count(*) AS found, {", ".join(
                f"count(*) FILTER (category = '{c}') AS {c}" for c in
                ("convention", "refactor", "warning", "error", "fatal"))}
              FROM f GROUP BY model, snippet_id),
            t AS (SELECT s.model, count(*) AS snippets,
              count(*) FILTER (found IS NULL) AS clean_snippets,
              CAST(sum(n) AS BIGINT) AS code_lines,
              CAST(sum(coalesce(found, 0)) AS BIGINT) AS findings, {", ".join(
                f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in
                ("convention", "refactor", "warning", "error", "fatal"))}
              FROM s LEFT JOIN p ON s.model = p.model AND s.snippet_id = p.snippet_id
              GROUP BY s.model)
        SELECT *, 100.0::DOUBLE * findings / code_lines AS findings_per_100_lines FROM t""",
    ),
]
