"""Incremental grading: each new attempt file is graded once, a restart continues.

Re-extracted answers either stand in the row already (``start_grading``) or come as a stream
of their own, later than the run they belong to (``start_joined_grading``).
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeworks.operators.grading import mark_timeouts, with_grade, with_printed
from gradeworks.streaming.state import state_on_disk


def graded(runs: DataFrame, integer_guard: bool = False) -> DataFrame:
    """Adds status and output to runs (batch or stream) that carry ``second_text``.

    Runs over the time limit count as timeouts, as in the batch plan.
    """
    return with_grade(with_printed(mark_timeouts(runs), integer_guard))


def start_grading(
    runs: DataFrame, output: str, checkpoint: str, integer_guard: bool = False
) -> StreamingQuery:
    """Grades what has arrived since the last start and appends it to a parquet table."""
    return _append(graded(runs, integer_guard), output, checkpoint)


def _append(rows: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    with state_on_disk(rows.sparkSession):
        return (
            rows.writeStream.format("parquet")
            .outputMode("append")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


@dataclass(frozen=True)
class Patience:
    """How long a run waits for its answer, and how far rows may come out of order, as intervals.

    Both are counted in the time the rows carry (``ended_at``, ``answered_at``).
    """

    answer: str = "1 day"
    disorder: str = "1 hour"


def graded_with_late_answers(
    runs: DataFrame, answers: DataFrame, patience: Patience, integer_guard: bool = False
) -> DataFrame:
    """Grades of streamed runs (row_no, ended_at, …) with streamed answers (row_no, text, answered_at).

    A run that needs no second look is graded as it comes and leaves no state. Every other run is
    kept until its answer comes, and graded with it; once no answer can come within the patience it
    is graded without one. The first of several answers to a run counts, and an answer without a
    waiting run leaves the state like any other row, so that the state holds no more than what
    came within the patience.
    """
    in_order = runs.withWatermark("ended_at", patience.disorder)
    looked = with_printed(mark_timeouts(in_order), integer_guard)
    settled = looked.where(~F.col("is_open")).withColumn("second_text", F.lit(None).cast("string"))
    known = answers.select(
        F.col("row_no").alias("answer_row"), F.col("text").alias("second_text"), "answered_at"
    )
    first = known.withWatermark("answered_at", patience.answer).dropDuplicatesWithinWatermark(["answer_row"])
    latest = F.col("ended_at") + F.expr(f"INTERVAL {patience.answer}")
    in_time = (F.col("answered_at") >= F.col("ended_at")) & (F.col("answered_at") <= latest)
    waiting = looked.where("is_open").join(first, (F.col("row_no") == F.col("answer_row")) & in_time, "left_outer")
    return with_grade(settled.unionByName(waiting.drop("answer_row", "answered_at")))


def start_joined_grading(
    runs: DataFrame,
    answers: DataFrame,
    output: str,
    checkpoint: str,
    patience: Patience,
    integer_guard: bool = False,
) -> StreamingQuery:
    """Grades what has arrived in both streams since the last start; waiting runs stay for the next one.

    Rows that come later than the stream's disorder allows are in neither the state nor the output:
    ``missed`` finds them, for the batch job to grade.
    """
    rows = graded_with_late_answers(runs, answers, patience, integer_guard)
    return _append(rows, output, checkpoint)


def closing_rows(spark: SparkSession, kind: str, rows: DataFrame, at: Column | str) -> DataFrame:
    """One row that, written behind the last file of a stream, tells it that nothing earlier comes.

    ``kind`` names the time column, ``at`` the time: later than the last row by more than the patience
    and the disorder. The row has no number and stays in the state itself, so nothing is graded for it.
    """
    columns = {kind: (F.lit(at) if isinstance(at, str) else at).cast("timestamp")}
    empty = {"stderr": F.lit(""), "stdout": F.lit("open"), "solution": F.lit("closed")}
    values = [
        columns.get(f.name, empty.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in rows.schema.fields
    ]
    return spark.range(1).select(*values)


def missed(runs: DataFrame, output: DataFrame, waiting_since: str) -> DataFrame:
    """Runs that ended before ``waiting_since`` and have no grade: they came too late for the stream."""
    old = runs.where(F.col("ended_at") < F.lit(waiting_since).cast("timestamp"))
    return old.join(output.select("row_no"), "row_no", "left_anti")
