"""Running leaderboard over a stream of graded attempts, kept up by differences.

The state has one entry for each year of a model: the first row of every pass below k of both
parts of its days. A batch touches the years its rows belong to and emits, for those whose verdicts
changed, what changed in the model's counts. The report is the version before plus the differences of
the batch, so that what a batch reads follows its new rows and the number of models. The days of a
year, a few dozen, are judged together, as a call of Python costs far more than a day's rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeworks.fixed_values import LAST_DAY
from gradeworks.functions.status import OK_CODE, status_code
from gradeworks.operators.reports import with_accuracy
from gradeworks.sources.versions import current_version, publish, read_version
from gradeworks.streaming.state import state_on_disk

COUNTS = ["total", "solved", "total_part1", "total_part2", "solved_part1", "solved_part2"]

# A year's passes, a row for each of these, a column for each pass: the number and status code of its first row.
_PASS = ["day", "part", "kpass", "row_no", "code"]
_STATE = ", ".join(f"{name} array<long>" for name in _PASS)
_CHANGES = "model string, " + ", ".join(f"{name} long" for name in COUNTS)
# Stand for a day that is null, and for a row number that is; the latter comes last.
_NO_DAY, _NO_ROW = -(1 << 62), (1 << 63) - 1


def first_rows(passes: np.ndarray) -> np.ndarray:
    """Of the rows of each pass the first, by day and part."""
    passes = passes[:, np.lexsort(passes[::-1])]
    new = np.ones(passes.shape[1], bool)
    new[1:] = (passes[:3, 1:] != passes[:3, :-1]).any(axis=0)
    return passes[:, new]


def days_counts(passes: np.ndarray) -> np.ndarray:
    """What days add to their model's counts: part 2 is gated, and left out on the last day."""
    days, place = np.unique(passes[0], return_inverse=True)
    solves = passes[4] == OK_CODE
    made = [np.bincount(place, passes[1] == part, len(days)) > 0 for part in (1, 2)]
    solved = [np.bincount(place, (passes[1] == part) & solves, len(days)) > 0 for part in (1, 2)]
    # Without a day it is not known whether there is a second part to attempt.
    second = made[0] & (days != LAST_DAY) & (~solved[0] | (made[1] & (days != _NO_DAY)))
    firsts, solved1 = made[0].sum(), (made[0] & solved[0]).sum()
    solved2 = (second & solved[0] & solved[1]).sum()
    return np.array([firsts + second.sum(), solved1 + solved2, firsts, second.sum(), solved1, solved2])


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change of a model's counts by one year's new attempts."""
    before = np.array(state.get if state.exists else [[]] * len(_PASS), np.int64)
    passes = before
    for batch in batches:
        passes = first_rows(np.concatenate([passes, batch[_PASS].to_numpy(np.int64).T], axis=1))
    state.update(tuple(row.tolist() for row in passes))
    change = days_counts(passes) - days_counts(before)
    if change.any():
        yield pd.DataFrame([[key[0], *change.tolist()]], columns=["model", *COUNTS])


def count_changes(attempts: DataFrame, k: int) -> DataFrame:
    """Streamed attempts as changes of their models' counts, best of k with part gating.

    A repeated attempt changes nothing, and an earlier pass that comes late changes what it would
    have changed in batch. A day, year or model that is null stands for itself, as in a grouping.
    Attempts of other parts than 1 and 2, or without a pass number, are in no count.
    """
    counted = attempts.where((F.col("kpass") < k) & F.col("part").isin(1, 2))
    coded = counted.select(
        "model",
        "year",
        F.coalesce(F.col("day").cast("long"), F.lit(_NO_DAY)).alias("day"),
        F.col("part").cast("long").alias("part"),
        F.col("kpass").cast("long").alias("kpass"),
        F.coalesce(F.col("row_no").cast("long"), F.lit(_NO_ROW)).alias("row_no"),
        F.coalesce(status_code(F.col("status")), F.lit(0)).cast("long").alias("code"),
    )
    return coded.groupBy("model", "year").applyInPandasWithState(
        _changes, _CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout
    )


def add_changes(spark: SparkSession, changes: DataFrame, output: str, batch_id: int) -> None:
    """Writes the version of a batch: the one before and the changes.

    A version is complete once it is published, and later ones do not touch it. A batch that runs
    again after a failure starts from the same version before, so its changes count once.
    """
    sums = [F.sum(name).cast("long").alias(name) for name in COUNTS]
    new = changes.groupBy("model").agg(*sums)
    # Two partial sums by model in one plan; the version before has a row for each model.
    if batch_id > 0:
        new = read_version(spark, output, batch_id - 1).unionByName(new).groupBy("model").agg(*sums)
    publish(new, output, batch_id)


def start_leaderboard(attempts: DataFrame, k: int, output: str, checkpoint: str) -> StreamingQuery:
    """Keeps the best-of-k accuracy per model up to date as attempts arrive."""
    spark = attempts.sparkSession
    with state_on_disk(spark):
        return (
            count_changes(attempts, k)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda changes, batch_id: add_changes(spark, changes, output, batch_id))
            .start()
        )


def read_leaderboard(spark: SparkSession, output: str) -> DataFrame:
    """The newest published report: counts and shares per model."""
    counts = read_version(spark, output, current_version(spark, output))
    return with_accuracy(counts.where("total > 0"))
