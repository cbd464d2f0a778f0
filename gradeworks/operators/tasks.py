"""Task tables: reshaping, filters and keyed matches of the challenge corpus."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.fixed_values import (
    FIRST_DAY,
    FIRST_YEAR,
    LAST_DAY,
    LAST_YEAR,
    NO_ERROR,
    PART1_FAILED,
)
from gradeworks.operators.dedup import dedup_rows
from gradeworks.schemas import DOC_KEYS, PART_KEYS


@dataclass(frozen=True)
class TaskSpan:
    """What a run covers: first and last year, first and last day, and the parts."""

    years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR)
    days: tuple[int, int] = (FIRST_DAY, LAST_DAY)
    parts: tuple[int, ...] = (1, 2)


def flatten_parts(nested: DataFrame) -> DataFrame:
    """Nested challenge records as nine flat columns; absent fields become null."""
    return nested.select(
        "year",
        "day",
        F.col("part1.description").alias("part1"),
        F.col("part1.converted_description").alias("part1_converted"),
        F.col("part1.answer").alias("part1_solution"),
        F.col("part2.description").alias("part2"),
        F.col("part2.converted_description").alias("part2_converted"),
        F.col("part2.answer").alias("part2_solution"),
        "input",
    )


def field_coverage(challenges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many challenges carry each optional field."""
    optional = ["part1_converted", "part2_converted", "input"]
    return challenges.groupBy(*(by or [])).agg(
        F.count("*").alias("challenges"),
        *[F.count(name).alias(f"with_{name}") for name in optional],
    )


def parts_as_rows(challenges: DataFrame) -> DataFrame:
    """One row per (year, day, part), in the same pass over the challenge table."""

    def part(n: int) -> Column:
        return F.struct(
            F.lit(n).alias("part"),
            F.col(f"part{n}").alias("description"),
            F.col(f"part{n}_converted").alias("converted"),
            F.col(f"part{n}_solution").alias("solution"),
        )

    return challenges.select(*DOC_KEYS, F.inline(F.array(part(1), part(2))))


def in_range(tasks: DataFrame, wanted: TaskSpan) -> DataFrame:
    """Tasks of the wanted years, days and parts."""
    kept = tasks.where(F.col("year").between(*wanted.years) & F.col("day").between(*wanted.days))
    return kept if 2 in wanted.parts else only_part_one(kept)


def only_part_one(tasks: DataFrame) -> DataFrame:
    """Part-1 rows; a table with one row per day has no part column and stays whole."""
    return tasks.where(F.col("part") == 1) if "part" in tasks.columns else tasks


def is_final_part2() -> Column:
    """The part that does not exist: part 2 of the last day. Never null."""
    return F.coalesce((F.col("day") == LAST_DAY) & (F.col("part") == 2), F.lit(False))


def drop_final_part2(rows: DataFrame) -> DataFrame:
    """Rows without part 2 of the last day."""
    return rows.where(~is_final_part2())


def finished_days(
    results: DataFrame, count_final_day: bool = False, only_part_one: bool = False
) -> DataFrame:
    """(year, day) pairs that need no rerun: exactly two earlier rows.

    ``count_final_day`` instead asks for part 1 and, where it is due, part 2. The last
    day, and every day of a part-one-only run, then count as finished too.
    """
    counted = results.groupBy(*DOC_KEYS).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("part") == 1).alias("part1_rows"),
        F.count_if(F.col("part") == 2).alias("part2_rows"),
    )
    if count_final_day:
        not_due = F.lit(only_part_one) | (F.col("day") == LAST_DAY)
        done = (F.col("part1_rows") > 0) & ((F.col("part2_rows") > 0) | not_due)
    else:
        done = F.col("rows") == 2
    return counted.where(done).select(*DOC_KEYS)


def resume_days(challenges: DataFrame, results: DataFrame, **options: bool) -> DataFrame:
    """Challenges still to run, given the rows of an earlier run."""
    return challenges.join(finished_days(results, **options), DOC_KEYS, "left_anti")


def resume_problems(problems: DataFrame, ignored: DataFrame) -> DataFrame:
    """Problems whose id is not in ``ignored``."""
    return problems.join(ignored.select("id"), "id", "left_anti")


def key_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that do not occur exactly once, with their row count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows <> 1")


def look_up(tasks: DataFrame, challenges: DataFrame) -> DataFrame:
    """Each task row with the challenge of its (year, day), nulls where there is none.

    The challenges are the small side; adaptive execution sends them to the tasks where they
    stay below its threshold, and splits the tasks of a hot (year, day) otherwise.
    """
    return tasks.join(challenges, DOC_KEYS, "left")


def look_up_faults(tasks: DataFrame, challenges: DataFrame) -> DataFrame:
    """(year, day) of tasks that do not have exactly one challenge: their tasks and challenges."""
    asked = tasks.groupBy(*DOC_KEYS).agg(F.count("*").alias("tasks"))
    known = challenges.groupBy(*DOC_KEYS).agg(F.count("*").alias("challenges"))
    counted = asked.join(known, DOC_KEYS, "left").fillna(0, ["challenges"])
    return counted.where("challenges <> 1")


def missing_keys(
    spark: SparkSession, challenges: DataFrame, wanted: TaskSpan = TaskSpan()
) -> DataFrame:
    """(year, day) pairs a run would ask for and the corpus lacks.

    A run asks for each year of the corpus with each day of the corpus, within the range.
    The calendar comes from the range alone, so its size is known before the data is read.
    """
    (first_year, last_year), (first_day, last_day) = wanted.years, wanted.days
    years, days = last_year - first_year + 1, last_day - first_day + 1
    calendar = spark.range(years * days).select(
        (F.lit(first_year) + F.floor(F.col("id") / days)).cast("int").alias("year"),
        (F.lit(first_day) + F.col("id") % days).cast("int").alias("day"),
    )
    # Without these two filters the three uses below would differ in what they read, and
    # each would run the aggregate anew.
    keyed = challenges.where("year IS NOT NULL AND day IS NOT NULL")
    present = keyed.groupBy(*DOC_KEYS).agg(F.count("*").alias("rows")).where("rows > 0")
    return (
        calendar.join(present.select("year"), "year", "left_semi")
        .join(present.select("day"), "day", "left_semi")
        .join(present, DOC_KEYS, "left_anti")
        .select(*DOC_KEYS)
    )


def choose_description(story: Column | bool, original: Column, converted: Column) -> Column:
    """The story wording or the converted wording."""
    flag = F.lit(story) if isinstance(story, bool) else story
    return F.when(flag, original).otherwise(converted)


def backfill_descriptions(challenges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Challenges with both descriptions replaced where ``fresh`` has the (year, day).

    ``fresh`` holds at most one row per key with columns part1 and part2.
    """
    renamed = fresh.select(
        *DOC_KEYS, F.col("part1").alias("new_part1"), F.col("part2").alias("new_part2")
    )
    joined = challenges.join(renamed, DOC_KEYS, "left")
    return joined.withColumns(
        {
            "part1": F.coalesce("new_part1", "part1"),
            "part2": F.coalesce("new_part2", "part2"),
        }
    ).select(*challenges.columns)


def failures_only(results: DataFrame) -> DataFrame:
    """Rows of failed attempts: neither solved nor blocked by part 1. No status is a failure."""
    settled = F.coalesce(F.col("status").isin(NO_ERROR, PART1_FAILED), F.lit(False))
    return results.where(~settled)


def ordered_tasks(tasks: DataFrame, *keys: str) -> DataFrame:
    """Tasks in run order; only for output, no operator needs an order."""
    return tasks.orderBy(*(keys or DOC_KEYS))


def assemble_challenges(
    parts: DataFrame, inputs: DataFrame | None = None, order: str = "row_no"
) -> DataFrame:
    """Nested challenge records from rows (year, day, part, description, answer).

    Of several copies of a part the last one by ``order``, a unique number, counts; the others are
    left out before any text is shuffled. ``inputs`` adds (year, day, input).
    """
    kept = dedup_rows(parts.where(F.col("part").isin(1, 2)), PART_KEYS, "last", order)

    def part(n: int) -> DataFrame:
        record = F.struct("description", "answer").alias(f"part{n}")
        return kept.where(F.col("part") == n).select(*[F.col(k).alias(f"{k}_{n}") for k in DOC_KEYS], record)

    same = [F.col(f"{k}_1").eqNullSafe(F.col(f"{k}_2")) for k in DOC_KEYS]
    keys = [F.coalesce(f"{k}_1", f"{k}_2").alias(k) for k in DOC_KEYS]
    nested = part(1).join(part(2), same, "full").select(*keys, "part1", "part2")
    return nested if inputs is None else nested.join(inputs, DOC_KEYS, "left")
