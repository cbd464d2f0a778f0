"""Reports over result rows: accuracy, status counts, day curves, error shares, ranking.

``by`` names the columns of a results list (a model, a file); two-part rows have year,
day, part, status and row_no, math rows id, status and row_no.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.fixed_values import (
    LAST_CURVE_DAY,
    MATH,
    NO_ERROR,
    PART1_FAILED,
    PLAIN_VARIANT,
    RUNTIME_ERROR,
    SUBSET_LABELS,
    SYNTAX_ERROR,
    TIMEOUT_ERROR,
    TWO_PART,
    VARIANT_NAMES,
    WRONG_OUTPUT,
)
from gradeworks.functions.numbers import percent, round_one_decimal, shade_bucket, share
from gradeworks.functions.status import OK_CODE, status_code
from gradeworks.operators.dedup import dedup_codes
from gradeworks.operators.tasks import drop_final_part2
from gradeworks.schemas import PART_KEYS
from gradeworks.sources.results import is_result_file, parse_result_name

ERROR_SHARES = {
    "syntax_errors": SYNTAX_ERROR,
    "runtime_errors": RUNTIME_ERROR,
    "timeout_errors": TIMEOUT_ERROR,
    "wrong_outputs": WRONG_OUTPUT,
}
SCORE_CELLS = [
    (TWO_PART, PLAIN_VARIANT),
    (TWO_PART, VARIANT_NAMES[TWO_PART]),
    (MATH, PLAIN_VARIANT),
    (MATH, VARIANT_NAMES[MATH]),
]


def is_code(status: str) -> Column:
    """Condition on a status code column."""
    return F.col("code") == status_code(F.lit(status))


def is_two_part(columns: list[str]) -> bool:
    """Which kind of results list this is, from its columns."""
    return set(PART_KEYS) <= set(columns)


def kept_codes(results: DataFrame, by: list[str], keep: str | None = None) -> DataFrame:
    """Result codes after the clean-up that precedes an accuracy report.

    Two-part rows lose part 2 of the last day and keep the last copy of a task, math rows
    keep the first copy; ``keep`` overrides which copy.
    """
    if is_two_part(results.columns):
        return dedup_codes(drop_final_part2(results), [*by, *PART_KEYS], keep or "last")
    return dedup_codes(results, [*by, "id"], keep or "first")


def status_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """Tasks per error class; two-part lists have the class of blocked part-2 rows too."""
    classes = [SYNTAX_ERROR, RUNTIME_ERROR, WRONG_OUTPUT, TIMEOUT_ERROR]
    if is_two_part(results.columns):
        classes.append(PART1_FAILED)
    counts = [F.count_if(is_code(c)).alias(c) for c in classes]
    return kept_codes(results, by).groupBy(*by).agg(*counts)


def accuracy_math(results: DataFrame, by: list[str]) -> DataFrame:
    """Solved share of the math subset in percent."""
    counted = kept_codes(results, by).groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("code") == OK_CODE).alias("solved")
    )
    return counted.withColumn("accuracy", percent(F.col("solved"), F.col("total")))


def accuracy_two_part(results: DataFrame, by: list[str]) -> DataFrame:
    """Solved share of the two-part subset in percent: overall, part 1, part 2.

    A part without rows has a null share.
    """
    return accuracy_from_codes(kept_codes(results, by), by)


def accuracy_from_codes(codes: DataFrame, by: list[str]) -> DataFrame:
    """The same from one code per task, as ``kept_codes`` returns them."""
    solved = F.col("code") == OK_CODE
    counted = codes.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(solved).alias("solved"),
        *[F.count_if(F.col("part") == p).alias(f"total_part{p}") for p in (1, 2)],
        *[F.count_if(solved & (F.col("part") == p)).alias(f"solved_part{p}") for p in (1, 2)],
    )
    return with_accuracy(counted)


def with_accuracy(counted: DataFrame) -> DataFrame:
    """Adds the shares to counts of two-part tasks, overall and by part."""
    return counted.withColumns(
        {
            "accuracy": percent(F.col("solved"), F.col("total")),
            "accuracy_part1": percent(F.col("solved_part1"), F.col("total_part1")),
            "accuracy_part2": percent(F.col("solved_part2"), F.col("total_part2")),
        }
    )


def accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of a results list of either kind, told apart by its columns."""
    report = accuracy_two_part if is_two_part(results.columns) else accuracy_math
    return report(results, by)


def _solved(part: int) -> Column:
    return F.count_if((F.col("part") == part) & (F.col("status") == NO_ERROR))


def solved_by_day(results: DataFrame) -> DataFrame:
    """Solved rows per day of the curve and part; a day without rows has 0.

    Rows are counted as they are, repeated ones included.
    """
    counted = (
        results.where(F.col("day").between(1, LAST_CURVE_DAY))
        .groupBy("day")
        .agg(_solved(1).alias("part1_solved"), _solved(2).alias("part2_solved"))
    )
    spark = results.sparkSession
    curve = spark.range(1, LAST_CURVE_DAY + 1).select(F.col("id").cast("int").alias("day"))
    return curve.join(counted, "day", "left").select(
        "day",
        F.coalesce("part1_solved", F.lit(0)).alias("part1_solved"),
        F.coalesce("part2_solved", F.lit(0)).alias("part2_solved"),
    )


def solved_by_day_series(results: DataFrame, file_column: str = "file_name") -> DataFrame:
    """Solved rows per day, both parts together, one curve per results file."""
    solved = F.col("part").isin(1, 2) & (F.col("status") == NO_ERROR)
    per_day = results.groupBy(file_column, "day").agg(F.count_if(solved).alias("solved"))
    curve = range(1, LAST_CURVE_DAY + 1)
    wide = per_day.groupBy(file_column).agg(
        *[F.max(F.when(F.col("day") == d, F.col("solved"))).alias(f"d{d}") for d in curve]
    )
    points = [
        F.struct(F.lit(d).alias("day"), F.coalesce(F.col(f"d{d}"), F.lit(0)).alias("solved"))
        for d in curve
    ]
    file_name = F.element_at(F.split(F.col(file_column), "/"), -1)
    series = F.replace(file_name, F.lit(".csv"), F.lit("")).alias("series")
    return wide.select(series, F.inline(F.array(*points)))


def accuracy_cube(results: DataFrame, path_column: str = "path") -> DataFrame:
    """Accuracy per model, subset, variant and k over the rows of all results files.

    Rows have the file's path, the task keys of either kind (null where they do not
    apply), status and row_no. All files are reduced together: one aggregation per task,
    one per file, and only then are the file names taken apart, once per file. Of several
    files for one cell the last path counts.
    """
    two_part = F.col("id").isNull()
    signed = F.when(two_part, F.col("row_no")).otherwise(-F.col("row_no")).alias("order")
    keys = [path_column, *PART_KEYS, "id"]
    kept = (
        drop_final_part2(results.where(is_result_file(F.col(path_column))))
        .select(*keys, status_code(F.col("status")).alias("code"), signed)
        .groupBy(*keys)
        .agg(F.max_by("code", "order").alias("code"))
    )
    files = kept.groupBy(path_column).agg(
        F.count("*").alias("total"), F.count_if(F.col("code") == OK_CODE).alias("solved")
    )
    cell = ["model", "subset", "variant", "k"]
    last_file = F.max(F.struct(path_column, "total", "solved")).alias("last_file")
    cells = parse_result_name(files, path_column).groupBy(*cell).agg(last_file)
    counted = cells.select(*cell, "last_file.total", "last_file.solved")
    return counted.withColumn("accuracy", percent(F.col("solved"), F.col("total")))


CUBE_KEYS = ["model", "subset", "variant", "k"]
# Each cell, a model over all subsets, a subset over all models, and everything of one k.
CUBE_TOTALS = [CUBE_KEYS, ["model", "k"], ["subset", "variant", "k"], ["k"]]


def with_totals(counted: DataFrame, keys: list[str], sets: list[list[str]], sums: list[str]) -> DataFrame:
    """Sums over each of the key sets, in one aggregate; a key that is summed over is null.

    ``level`` tells the sets apart, also where a key is null by itself: its bits are the keys, the first
    one highest, and a bit is 1 for a key that is summed over.
    """
    grouped = counted.groupingSets([[F.col(k) for k in one] for one in sets], *keys)
    return grouped.agg(
        *[F.sum(name).alias(name) for name in sums], F.grouping_id().cast("long").alias("level")
    )


def accuracy_rollup(cube: DataFrame) -> DataFrame:
    """The accuracy cube with totals per model, per subset and overall, at each k.

    Tasks are summed, so a total weighs a subset by its tasks; ``overall_score`` is the mean of subsets.
    """
    summed = with_totals(cube, CUBE_KEYS, CUBE_TOTALS, ["total", "solved"])
    return summed.withColumn("accuracy", percent(F.col("solved"), F.col("total")))


def cell_name(subset: str, variant: str, k: int) -> str:
    """Column name of a leaderboard cell."""
    return f"{subset}_{variant}_k{k}"


def _cell(subset: str, variant: str, k: int) -> Column:
    here = (F.col("subset") == subset) & (F.col("variant") == variant) & (F.col("k") == k)
    return F.max(F.when(here, F.col("accuracy")))


def leaderboard(cube: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row per model, one fixed column per subset, variant and k; a missing cell is null."""
    cells = [
        _cell(subset, variant, k).alias(cell_name(subset, variant, k))
        for subset, variant in SCORE_CELLS
        for k in ks
    ]
    return cube.groupBy(F.translate("model", "_", "-").alias("model")).agg(*cells)


def overall_score(cube: DataFrame, k: int = 3) -> DataFrame:
    """Mean accuracy over the subset variants at k, ranked; incomplete rows are flagged."""
    names = [f"c{i}" for i in range(len(SCORE_CELLS))]
    wide = cube.groupBy("model").agg(
        *[_cell(s, v, k).alias(n) for n, (s, v) in zip(names, SCORE_CELLS)]
    )
    filled = sum(F.col(n).isNotNull().cast("int") for n in names)
    summed = sum(F.coalesce(F.col(n), F.lit(0.0)) for n in names)
    scored = wide.select(
        "model",
        filled.alias("cells"),
        F.when(filled > 0, summed / filled).alias("score"),
        (filled < len(names)).alias("incomplete"),
    )
    return ranked(scored, "score")


def ranked(rows: DataFrame, score: str) -> DataFrame:
    """Adds ``rank``, 1 for the highest score; ties share a rank, rows without a score have none.

    Scores are first reduced to distinct values. Their least, their greatest and their number cut
    them into as many ranges as a range holds scores on average. The ranges are ordered in parallel;
    only their totals, the root of the number of scores, are summed in one place.
    """
    scores = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("score_rows"))
    value = F.col(score).cast("double")
    bounds = [F.min(value).alias("low"), F.max(value).alias("high"), F.sqrt(F.count("*")).alias("ranges")]
    found = scores.agg(F.struct(*bounds).alias("bounds")).scalar()
    bounded = scores.withColumn("bounds", found)
    span = F.col("bounds.high") - F.col("bounds.low")
    place = F.when(span > 0, F.floor((F.col("bounds.high") - value) / span * F.col("bounds.ranges")))
    placed = bounded.select(score, "score_rows", F.coalesce(place, F.lit(0)).alias("range"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(F.sum("score_rows").alias("range_rows"))
    higher = F.sum("range_rows").over(before(Window.orderBy("range")))
    offsets = totals.select("range", F.coalesce(higher, F.lit(0)).alias("offset"))
    own = F.sum("score_rows").over(before(Window.partitionBy("range").orderBy(F.desc(score))))
    within = placed.withColumn("own", F.coalesce(own, F.lit(0)))
    ranks = within.join(offsets, "range").select(score, (1 + F.col("offset") + F.col("own")).alias("rank"))
    return rows.join(ranks, score, "left").select(*rows.columns, "rank")


def error_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """Failed tasks and those of each error class (``n_…``), after keeping the first copy.

    Rows may be of either kind, or of both with nulls in the other kind's keys.
    """
    task = [c for c in [*PART_KEYS, "id"] if c in results.columns]
    kept = dedup_codes(results, [*by, *task], "first")
    # A null code is a failure too: only solved and blocked rows are taken out.
    out = F.coalesce(is_code(NO_ERROR) | is_code(PART1_FAILED), F.lit(False))
    return kept.groupBy(*by).agg(
        F.count_if(~out).alias("total_errors"),
        *[F.count_if(is_code(s)).alias(f"n_{name}") for name, s in ERROR_SHARES.items()],
    )


def error_shares(results: DataFrame, by: list[str]) -> DataFrame:
    """Failed tasks and the share of each error class; a list without failures has null shares."""
    return _shares_of(error_counts(results, by), by)


def _shares_of(counted: DataFrame, by: list[str]) -> DataFrame:
    shares = [share(F.col(f"n_{n}"), F.col("total_errors")).alias(n) for n in ERROR_SHARES]
    return counted.select(*by, "total_errors", *shares)


def error_rollup(counted: DataFrame) -> DataFrame:
    """Error shares per model and subset with totals per model, per subset and overall, from ``error_counts``."""
    keys, sums = ["model", "subset"], ["total_errors", *[f"n_{name}" for name in ERROR_SHARES]]
    summed = with_totals(counted, keys, [keys, ["model"], ["subset"], []], sums)
    return _shares_of(summed, [*keys, "level"])


def error_percentages(shares: DataFrame, by: list[str]) -> DataFrame:
    """Shares in percent with one decimal, in the order of the printed report."""
    columns = [round_one_decimal(F.col(n) * 100).alias(n) for n in ERROR_SHARES]
    return shares.select(*by, *columns, "total_errors")


def error_buckets(percentages: DataFrame) -> DataFrame:
    """Adds the shade index of each share."""
    return percentages.withColumns(
        {f"{name}_bucket": shade_bucket(F.col(name)) for name in ERROR_SHARES}
    )


def with_subset_label(rows: DataFrame) -> DataFrame:
    """Adds the printed label of the subset; null for a subset without one."""
    pairs = [F.lit(v) for pair in SUBSET_LABELS.items() for v in pair]
    return rows.withColumn("label", F.try_element_at(F.create_map(*pairs), F.col("subset")))


def without_subset_label(rows: DataFrame) -> DataFrame:
    """Rows that no label exists for, kept aside instead of failing the report."""
    return with_subset_label(rows).where("label IS NULL").drop("label")


def distinct_statuses(results: DataFrame) -> DataFrame:
    """Statuses that occur."""
    return results.select("status").distinct()
