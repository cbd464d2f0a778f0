"""Queries: reshaping, filters and keyed matches of the challenge corpus."""

from pyspark.sql import functions as F

from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query
from gradeworks.operators import tasks as T

FLAT = (
    "year, day, part1, part1_converted, part1_solution, part2, part2_converted, "
    "part2_solution, input"
)
KEY_FIXED_DAYS = "WHERE NOT (day = 25 AND part = 2)"


def _challenges(s, d):
    return V.CHALLENGES.frame(s, d)


def nested(s, d):
    """The challenges as nested records, the shape of the corpus files."""

    def part(n):
        return F.struct(
            F.col(f"part{n}").alias("description"),
            F.col(f"part{n}_solution").alias("answer"),
            F.col(f"part{n}_converted").alias("converted_description"),
        ).alias(f"part{n}")

    return _challenges(s, d).select("year", "day", part(1), part(2), "input")


def _parts(s, d):
    first, second = [v.frame(s, d) for v in V.PART_RECORDS]
    return first.unionByName(second)


_PARTS = " UNION ALL ".join(v.sql for v in V.PART_RECORDS)


def _assembled(s, d):
    records = T.assemble_challenges(_parts(s, d), V.INPUTS.frame(s, d))
    return records.select(
        "year", "day", F.to_json(F.struct("year", "day", "part1", "part2", "input")).alias("json")
    )


QUERIES = [
    Query(
        "flatten_parts",
        lambda s, d: T.flatten_parts(nested(s, d)),
        f"SELECT {FLAT} FROM ({V.CHALLENGES.sql})",
    ),
    Query(
        "field_coverage",
        lambda s, d: T.field_coverage(_challenges(s, d), ["day"]),
        f"""SELECT day, count(*) AS challenges, count(part1_converted) AS with_part1_converted,
            count(part2_converted) AS with_part2_converted, count(input) AS with_input
        FROM ({V.CHALLENGES.sql}) GROUP BY day""",
    ),
    Query(
        "unpivot_parts",
        lambda s, d: T.parts_as_rows(_challenges(s, d)),
        f"""WITH c AS ({V.CHALLENGES.sql})
        SELECT year, day, 1 AS part, part1 AS description, part1_converted AS converted,
            part1_solution AS solution FROM c
        UNION ALL SELECT year, day, 2, part2, part2_converted, part2_solution FROM c""",
    ),
    Query(
        "assemble_nested",
        _assembled,
        f"""WITH p AS ({_PARTS}), i AS ({V.INPUTS.sql}),
        one AS (SELECT * FROM p WHERE part = 1), two AS (SELECT * FROM p WHERE part = 2)
        SELECT one.year, one.day, CAST(CASE WHEN two.year IS NULL
          THEN to_json(struct_pack(year := one.year, day := one.day,
            part1 := struct_pack(description := one.description, answer := one.answer),
            input := i.input))
          ELSE to_json(struct_pack(year := one.year, day := one.day,
            part1 := struct_pack(description := one.description, answer := one.answer),
            part2 := struct_pack(description := two.description, answer := two.answer),
            input := i.input)) END AS VARCHAR) AS json
        FROM one LEFT JOIN two ON one.year = two.year AND one.day = two.day
        LEFT JOIN i ON one.year = i.year AND one.day = i.day""",
    ),
    Query(
        "range_filter",
        lambda s, d: T.in_range(V.ATTEMPTS.frame(s, d), T.TaskSpan((2016, 2020), (3, 24))),
        f"""SELECT * FROM ({V.ATTEMPTS.sql})
        WHERE year BETWEEN 2016 AND 2020 AND day BETWEEN 3 AND 24""",
    ),
    Query(
        "only_part_one",
        lambda s, d: T.only_part_one(V.ATTEMPTS.frame(s, d)),
        f"SELECT * FROM ({V.ATTEMPTS.sql}) WHERE part = 1",
    ),
    Query(
        "drop_final_part2",
        lambda s, d: T.drop_final_part2(V.ATTEMPTS.frame(s, d)),
        f"SELECT * FROM ({V.ATTEMPTS.sql}) {KEY_FIXED_DAYS}",
    ),
    Query(
        "resume_anti_join",
        lambda s, d: T.resume_days(
            _challenges(s, d).select("year", "day", "part1_solution"),
            V.USER_DAYS.frame(s, d).where("status = 'no_error'"),
        ),
        f"""WITH done AS (SELECT year, day FROM ({V.USER_DAYS.sql}) WHERE status = 'no_error'
            GROUP BY year, day HAVING count(*) = 2)
        SELECT year, day, part1_solution FROM ({V.CHALLENGES.sql}) c WHERE NOT EXISTS (
            SELECT 1 FROM done WHERE done.year = c.year AND done.day = c.day)""",
    ),
    Query(
        "resume_due_parts",
        lambda s, d: T.resume_days(
            _challenges(s, d).select("year", "day", "part1_solution"),
            V.USER_DAYS.frame(s, d).where("status = 'no_error'"),
            count_final_day=True,
        ),
        f"""WITH done AS (SELECT year, day FROM ({V.USER_DAYS.sql}) WHERE status = 'no_error'
            GROUP BY year, day HAVING count(*) FILTER (part = 1) > 0
            AND (day = 25 OR count(*) FILTER (part = 2) > 0))
        SELECT year, day, part1_solution FROM ({V.CHALLENGES.sql}) c WHERE NOT EXISTS (
            SELECT 1 FROM done WHERE done.year = c.year AND done.day = c.day)""",
    ),
    Query(
        "ignore_ids",
        lambda s, d: T.resume_problems(
            V.PROBLEMS.frame(s, d).select("id", "solution"),
            V.RESULTS_MATH.frame(s, d).where("status = 'no_error'").select("id").distinct(),
        ),
        f"""SELECT id, solution FROM ({V.PROBLEMS.sql}) WHERE id NOT IN (
            SELECT id FROM ({V.RESULTS_MATH.sql}) WHERE status = 'no_error')""",
    ),
    Query(
        "key_uniqueness",
        lambda s, d: T.key_violations(
            V.ATTEMPTS.frame(s, d), ["model", "year", "day", "part", "kpass"]
        ),
        f"""SELECT model, year, day, part, kpass, count(*) AS rows FROM ({V.ATTEMPTS.sql})
        GROUP BY model, year, day, part, kpass HAVING count(*) <> 1""",
    ),
    Query(
        "look_up",
        lambda s, d: T.look_up(
            V.ASKED_DAYS.frame(s, d), _challenges(s, d).select("year", "day", "part1_solution")
        ),
        f"""SELECT t.row_no, t.year, t.day, c.part1_solution FROM ({V.ASKED_DAYS.sql}) t
        LEFT JOIN ({V.CHALLENGES.sql}) c ON t.year = c.year AND t.day = c.day""",
    ),
    Query(
        "look_up_faults",
        lambda s, d: T.look_up_faults(V.ASKED_DAYS.frame(s, d), _challenges(s, d)),
        f"""SELECT year, day, count(DISTINCT row_no) AS tasks, count(solution) AS challenges
        FROM (SELECT t.*, c.part1_solution AS solution FROM ({V.ASKED_DAYS.sql}) t
            LEFT JOIN ({V.CHALLENGES.sql}) c ON t.year = c.year AND t.day = c.day)
        GROUP BY year, day HAVING count(solution) <> count(DISTINCT row_no)""",
    ),
    Query(
        "missing_keys",
        lambda s, d: T.missing_keys(s, V.USER_DAYS.frame(s, d)),
        f"""WITH k AS (SELECT DISTINCT year, day FROM ({V.USER_DAYS.sql})
            WHERE year BETWEEN 2015 AND 2022 AND day BETWEEN 1 AND 25)
        SELECT y.year, x.day FROM (SELECT DISTINCT year FROM k) y
        CROSS JOIN (SELECT DISTINCT day FROM k) x
        WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.year = y.year AND k.day = x.day)""",
    ),
    Query(
        "choose_description",
        lambda s, d: T.parts_as_rows(_challenges(s, d)).select(
            "year",
            "day",
            "part",
            T.choose_description(
                F.col("day") < 13, F.col("description"), F.col("converted")
            ).alias("description"),
        ),
        f"""WITH c AS ({V.CHALLENGES.sql})
        SELECT year, day, 1 AS part, CASE WHEN day < 13 THEN part1 ELSE part1_converted END
            AS description FROM c
        UNION ALL SELECT year, day, 2, CASE WHEN day < 13 THEN part2 ELSE part2_converted END
            FROM c""",
    ),
    Query(
        "backfill_faults",
        lambda s, d: T.key_violations(
            V.FRESH.frame(s, d).union(V.FRESH.frame(s, d).where("day % 5 = 0")), ["year", "day"]
        ),
        f"SELECT year, day, CAST(2 AS BIGINT) AS rows FROM ({V.FRESH.sql}) WHERE day % 5 = 0",
    ),
    Query(
        "backfill_join",
        lambda s, d: T.backfill_descriptions(_challenges(s, d), V.FRESH.frame(s, d)),
        f"""SELECT c.year, c.day, coalesce(f.part1, c.part1) AS part1, part1_converted,
            part1_solution, coalesce(f.part2, c.part2) AS part2, part2_converted,
            part2_solution, input FROM ({V.CHALLENGES.sql}) c
        LEFT JOIN ({V.FRESH.sql}) f ON c.year = f.year AND c.day = f.day""",
    ),
]
