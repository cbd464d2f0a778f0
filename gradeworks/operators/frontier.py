"""The work a run has left: the next prompt of every task that is due.

A run covers a span of challenges with up to k passes for each part. A day is due with part 1 until
that is solved or out of passes, and then, if it is solved, with part 2; the last day has no part 2.
What is finished is kept as passes, integers only, in segments of a versioned snapshot: new attempts
are merged into the segments they belong to, and the rest of the state is not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.fixed_values import LAST_DAY
from gradeworks.functions.status import FAILED_CALL_CODE, OK_CODE
from gradeworks.operators.hotkeys import sent_if_sparse
from gradeworks.operators.passes import SPINE_KEYS, day_table, pass_table
from gradeworks.operators.prompts import chat_part1, chat_part2, math_prompt, pass_history
from gradeworks.operators.tasks import TaskSpan
from gradeworks.schemas import DOC_KEYS, PROBLEM_KEYS, TASK_KEYS
from gradeworks.sources.snapshots import read_snapshot, save_snapshot

ID_RANGE = 1000


def _pass_state(keys: list[str]) -> T.StructType:
    kinds = {"model": T.StringType(), "row_no": T.LongType()}
    names = [*keys, "kpass", "code", "row_no"]
    return T.StructType([T.StructField(n, kinds.get(n, T.IntegerType())) for n in names])


def merge_attempts(
    attempts: DataFrame, root: str, segment: Column, keys: list[str] = TASK_KEYS, failed_calls: bool = False
) -> int:
    """Adds attempts to the passes kept below ``root``; returns the new version.

    Attempts may come late, in any order and several times: of a pass the first row counts. Only the
    segments that the attempts belong to are read and written; their names come to the driver.
    """
    spark = attempts.sparkSession
    new = pass_table(attempts, keys, failed_calls)
    touched = [str(r[0]) for r in attempts.select(segment.cast("string")).distinct().collect()]
    old = read_snapshot(spark, root, _pass_state(keys), segments=touched)
    both = old.unionByName(new.select(*old.columns))
    merged = both.groupBy(*keys, "kpass").agg(
        F.min_by("code", "row_no").alias("code"), F.min("row_no").alias("row_no")
    )
    return save_snapshot(merged, root, segment)


def kept_passes(spark: SparkSession, root: str, keys: list[str] = TASK_KEYS) -> DataFrame:
    """The passes merged so far, of the last complete version."""
    return read_snapshot(spark, root, _pass_state(keys))


def run_days(challenges: DataFrame, models: DataFrame, span: TaskSpan = TaskSpan()) -> DataFrame:
    """(model, year, day) a run of each model goes over: the challenges within the span, by year."""
    years = models.select("model", F.explode(F.sequence(*map(F.lit, span.years))).alias("year"))
    days = challenges.where(F.col("day").between(*span.days)).select(*DOC_KEYS)
    return days.join(sent_if_sparse(years), "year")


def due_days(days: DataFrame, passes: DataFrame, k: int) -> DataFrame:
    """The due part of each day with its next pass: (model, year, day, part, kpass, solved_row).

    ``solved_row`` is the attempt that solved part 1, which the prompt of part 2 continues.
    """
    made = day_table(passes.where(F.col("kpass") < k))
    tasks = days.join(made, SPINE_KEYS, "left")

    def solved(part: int) -> Column:
        return F.coalesce(F.col(f"p{part}_end_code") == OK_CODE, F.lit(False))

    def following(part: int) -> Column:
        return F.coalesce(F.col(f"p{part}_last_pass") + 1, F.lit(0))

    first = ~solved(1) & (following(1) < k)
    second = solved(1) & (F.col("day") != LAST_DAY) & ~solved(2) & (following(2) < k)
    part = F.when(first, 1).when(second, 2).alias("part")
    kpass = F.when(first, following(1)).otherwise(following(2)).cast("int").alias("kpass")
    solved_row = F.when(second, F.col("p1_end_row_no")).alias("solved_row")
    return tasks.where(first | second).select(*SPINE_KEYS, part, kpass, solved_row)


def due_prompts(due: DataFrame, challenges: DataFrame, generations: DataFrame) -> DataFrame:
    """The due tasks with the messages to send: (model, year, day, part, kpass, messages).

    ``challenges`` has year, day and description (of part 1), ``generations`` row_no and response. The
    due rows go to the responses where their size allows it.
    """
    texts = challenges.select(*DOC_KEYS, "description")
    described = due.join(texts, DOC_KEYS)
    keys = [*SPINE_KEYS, "part", "kpass"]
    opening = described.where("part = 1").select(*keys, chat_part1(F.col("description")).alias("messages"))
    waiting = sent_if_sparse(due.where("part = 2")).withColumnRenamed("solved_row", "row_no")
    answered = generations.select("row_no", "response").join(waiting, "row_no").join(texts, DOC_KEYS)
    history = pass_history(F.col("description"), F.col("response"))
    return opening.unionByName(answered.select(*keys, chat_part2(history).alias("messages")))


def due_problems(problems: DataFrame, models: DataFrame, passes: DataFrame, k: int) -> DataFrame:
    """Problems each model still has to run, with the next pass and its prompt.

    ``models`` has model, first_id and last_id. A failed call ends the passes of a problem, as a
    success does.
    """
    place = lambda c: F.floor(F.col(c) / ID_RANGE)
    ranges = models.withColumn("place", F.explode(F.sequence(place("first_id"), place("last_id"))))
    asked = problems.withColumn("place", place("id")).join(ranges, "place")
    asked = asked.where(F.col("id").between(F.col("first_id"), F.col("last_id")))
    ended = F.max(F.col("code").isin(OK_CODE, FAILED_CALL_CODE)).alias("ended")
    made = passes.where(F.col("kpass") < k).groupBy(*PROBLEM_KEYS).agg(F.max("kpass").alias("last_pass"), ended)
    tasks = asked.join(made, PROBLEM_KEYS, "left")
    following = F.coalesce(F.col("last_pass") + 1, F.lit(0)).cast("int")
    due = tasks.where(~F.coalesce("ended", F.lit(False)) & (following < k))
    prompt = math_prompt(F.col("title"), F.col("description"))
    return due.select(*PROBLEM_KEYS, following.alias("kpass"), prompt.alias("prompt"))
