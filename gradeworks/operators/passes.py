"""Passes of a task: first pass, best of k, early stop, part gating.

Attempts have columns model, year, day, part (or other task keys), ``kpass``, ``status`` and
``row_no``, a unique row order. Of several rows for one pass the first one counts; a pass
without a status was made and did not succeed. Every selection combines rows per task and
pass, then per task, in hash aggregates over integers: no sort, no window, the same for
every k, and a task that holds a third of the table is combined before each shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.fixed_values import LAST_DAY, NO_ERROR, PART1_FAILED
from gradeworks.functions.status import (
    FAILED_CALL_CODE,
    OK_CODE,
    status_code,
    status_name,
)
from gradeworks.operators.hotkeys import join_sparse_values, sent_if_sparse
from gradeworks.schemas import TASK_KEYS

SPINE_KEYS = ["model", "year", "day"]


def pass_table(attempts: DataFrame, keys: list[str] = TASK_KEYS, failed_calls: bool = False) -> DataFrame:
    """One row per task and pass: code and row number of its first row.

    With ``failed_calls`` a row with a ``provider_error`` is a failed call and has no status.
    """
    code = F.coalesce(status_code(F.col("status")), F.lit(0))
    if failed_calls:
        code = F.when(F.col("provider_error").isNotNull(), FAILED_CALL_CODE).otherwise(code)
    coded = attempts.select(*keys, "kpass", code.alias("code"), "row_no")
    return coded.groupBy(*keys, "kpass").agg(
        F.min_by("code", "row_no").alias("code"), F.min("row_no").alias("row_no")
    )


def _ends_run(code: Column) -> Column:
    """No pass follows this one: it succeeded, or its model call failed."""
    return code.isin(OK_CODE, FAILED_CALL_CODE)


def _task_columns(here: Column | None = None, name: str = "") -> list[Column]:
    """Of a task's passes that are ``here``: the first that ends the run, the last, and pass 0."""

    def among(condition: Column) -> Column:
        return F.when(condition if here is None else condition & here, F.col("kpass"))

    end, any_pass = among(_ends_run(F.col("code"))), among(F.lit(True))
    start = among(F.col("kpass") == 0)
    columns = {"end_pass": F.min(end), "last_pass": F.max(any_pass)}
    for field in ("code", "row_no"):
        columns[f"end_{field}"] = F.min_by(field, end)
        columns[f"last_{field}"] = F.max_by(field, any_pass)
        columns[f"start_{field}"] = F.min_by(field, start)
    return [column.alias(name + key) for key, column in columns.items()]


def _best(field: str, name: str = "") -> Column:
    """Field of the first pass that ends the run, otherwise of the last one made."""
    if field == "kpass":
        return F.coalesce(f"{name}end_pass", f"{name}last_pass")
    ended = F.col(f"{name}end_pass").isNotNull()
    return F.when(ended, F.col(f"{name}end_{field}")).otherwise(F.col(f"{name}last_{field}"))


def best_of_k(
    attempts: DataFrame, k: int, keys: list[str] = TASK_KEYS, failed_calls: bool = False
) -> DataFrame:
    """Per task the first success among passes below k, otherwise the last pass.

    With ``failed_calls``, a task whose model call failed before any success has no row.
    Returns the keys, ``kpass``, ``status`` and the ``row_no`` of the chosen attempt; long
    texts are joined by row number where an export needs them (``attach_texts``).
    """
    passes = pass_table(attempts.where(F.col("kpass") < k), keys, failed_calls)
    tasks = passes.groupBy(*keys).agg(*_task_columns())
    fields = [_best(field).alias(field) for field in ("kpass", "code", "row_no")]
    return _named(tasks.select(*keys, *fields), keys)


def _named(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen passes with the status in place of its code, less those of failed calls."""
    graded = chosen.where(F.col("code") != FAILED_CALL_CODE)
    return graded.select(*keys, "kpass", status_name(F.col("code")).alias("status"), "row_no")


def first_pass(
    attempts: DataFrame,
    keys: list[str] = TASK_KEYS,
    numbering: str = "exact",
    failed_calls: bool = False,
) -> DataFrame:
    """The first pass of each task: pass 0, or with ``numbering='gaps'`` the lowest one."""
    if numbering not in ("exact", "gaps"):
        raise ValueError(f"unknown numbering {numbering}")
    made = attempts.where(F.col("kpass") == 0) if numbering == "exact" else attempts
    tasks = pass_table(made, keys, failed_calls).groupBy(*keys).agg(
        F.min("kpass").alias("kpass"),
        F.min_by("code", "kpass").alias("code"),
        F.min_by("row_no", "kpass").alias("row_no"),
    )
    return _named(tasks, keys)


def early_stop(attempts: DataFrame, keys: list[str] = TASK_KEYS) -> DataFrame:
    """Attempts a run that stops at the first success would have made.

    Adds ``stop_pass``, the pass of the first success, null if there is none.
    """
    solved = F.when(F.col("status") == NO_ERROR, F.col("kpass"))
    stops = attempts.groupBy(*keys).agg(
        F.min(solved).alias("stop_pass"), F.count("*").alias("group_rows")
    )
    solved_tasks = F.col("stop_pass").isNotNull()
    joined = join_sparse_values(attempts, stops, keys, F.col("row_no"), solved_tasks)
    return joined.where(F.col("stop_pass").isNull() | (F.col("kpass") <= F.col("stop_pass")))


def day_table(passes: DataFrame) -> DataFrame:
    """One row per (model, year, day) with what counts of the passes of both parts."""
    parts = [_task_columns(F.col("part") == part, f"p{part}_") for part in (1, 2)]
    return passes.groupBy(*SPINE_KEYS).agg(*parts[0], *parts[1])


def _result_row(k: int, passno: Column, code: Column, row_no: Column, part: int = 0) -> Column:
    """One row of the list for k."""
    return F.struct(
        F.lit(k).alias("k"),
        F.lit(part).alias("part"),
        passno.cast("int").alias("kpass"),
        code.cast("int").alias("code"),
        row_no.cast("long").alias("row_no"),
    )


def _as_rows(groups: DataFrame, keys: list[str], *rows: Column) -> DataFrame:
    """The rows that exist, one below the other, with their status."""
    exists = lambda row: row.isNotNull() & row["code"].isNotNull()
    made = groups.select(*keys, F.explode(F.filter(F.array(*rows), exists)).alias("row"))
    status = status_name(F.col("row.code")).alias("status")
    return made.select(*keys, "row.part", "row.kpass", status, "row.row_no", "row.k")


def _gated_rows(k: int) -> list[Column]:
    """Best-of-k rows of a day, part 2 gated by part 1."""
    code1 = _best("code", "p1_")
    part1, made2 = (
        _result_row(k, *[_best(f, f"p{part}_") for f in ("kpass", "code", "row_no")], part=part)
        for part in (1, 2)
    )
    nothing = F.lit(None)
    blocked = _result_row(k, nothing, status_code(F.lit(PART1_FAILED)), nothing, part=2)
    part2 = F.when(code1 != OK_CODE, blocked).when(
        code1.isNotNull() & (F.col("day") != LAST_DAY), made2
    )
    return [part1, part2]


def _first_rows(gate: str) -> list[Column]:
    """First-pass rows of a day; part 2 has one if the gate is open."""
    if gate not in ("k", "1"):
        raise ValueError(f"unknown gate {gate}")
    solved = (_best("code", "p1_") if gate == "k" else F.col("p1_start_code")) == OK_CODE
    part1, part2 = (
        _result_row(1, F.lit(0), F.col(f"p{part}_start_code"), F.col(f"p{part}_start_row_no"), part)
        for part in (1, 2)
    )
    is_open = F.coalesce(solved, F.lit(False)) & (F.col("day") != LAST_DAY)
    return [part1, F.when(is_open, part2)]


def gated_from_passes(passes: DataFrame, k: int) -> DataFrame:
    """Best-of-k results with part gating from the passes below k (``pass_table``)."""
    return _as_rows(day_table(passes), SPINE_KEYS, *_gated_rows(k)).drop("k")


def _passes_below(attempts: DataFrame, k: int) -> DataFrame:
    return pass_table(attempts.where(F.col("kpass") < k))


def part_gating(attempts: DataFrame, k: int) -> DataFrame:
    """Best-of-k rows of both parts; part 2 counts only if part 1 was solved within k.

    Otherwise part 2 is one ``part1_failed`` row without pass and row number, whether or
    not part 2 was attempted. The last day has no attempted part 2.
    """
    return gated_from_passes(_passes_below(attempts, k), k)


def first_pass_gated(attempts: DataFrame, k: int, gate: str = "k") -> DataFrame:
    """First-pass rows; part 2 has one if part 1 was solved within k.

    With ``gate='1'`` part 1 must have been solved by its own first pass.
    """
    days = day_table(_passes_below(attempts, k))
    return _as_rows(days, SPINE_KEYS, *_first_rows(gate)).drop("k")


def both_lists(attempts: DataFrame, k: int, gate: str = "k") -> DataFrame:
    """The best-of-k list and the first-pass list of a run, told apart by column ``k``.

    The attempts, however costly to grade, are read once for both. With k = 1 there is
    one list.
    """
    days = day_table(_passes_below(attempts, k))
    rows = _gated_rows(k) + (_first_rows(gate) if k > 1 else [])
    return _as_rows(days, SPINE_KEYS, *rows)


def both_flat_lists(
    attempts: DataFrame, k: int, keys: list[str], failed_calls: bool = True
) -> DataFrame:
    """The same for tasks without parts, whose attempts may be failed calls."""
    passes = pass_table(attempts.where(F.col("kpass") < k), keys, failed_calls)
    tasks = passes.groupBy(*keys).agg(*_task_columns())
    rows = [_result_row(k, *[_best(field) for field in ("kpass", "code", "row_no")])]
    if k > 1:
        rows.append(_result_row(1, F.lit(0), F.col("start_code"), F.col("start_row_no")))
    made = [F.when(row["code"] != FAILED_CALL_CODE, row) for row in rows]
    return _as_rows(tasks, keys, *made).drop("part")


def attach_texts(results: DataFrame, attempts: DataFrame, columns: list[str]) -> DataFrame:
    """Results with long columns of the chosen attempt, matched by the unique row number.

    The chosen numbers go to the attempts where their size allows it, so that texts which are not
    chosen stay where they are. Results without an attempt have nulls.
    """
    texts = attempts.select("row_no", *columns)
    chosen = sent_if_sparse(results.where(F.col("row_no").isNotNull()))
    nothing = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in columns]
    blocked = results.where(F.col("row_no").isNull()).select(*results.columns, *nothing)
    return texts.join(chosen, "row_no").select(*results.columns, *columns).unionByName(blocked)
