"""Streams give the answer of the batch job, across restarts and new files."""

import random
from datetime import datetime, timedelta

from gradeworks.plans.evaluation import best_of_k_accuracy
from gradeworks.streaming.grading import Patience, closing_rows, graded, missed, start_grading, start_joined_grading
from gradeworks.streaming.leaderboard import COUNTS, add_changes, read_leaderboard, start_leaderboard
from gradeworks.streaming.state import PARTITIONS, PROVIDER, ROCKSDB, state_on_disk
from test_passes import SCHEMA, random_attempts

RUNS = "row_no long, stdout string, stderr string, solution string, second_text string, duration_s double"


def some_runs(first, last):
    rng = random.Random(first)
    return [(i, rng.choice(["5", "6", "x"]), rng.choice(["", "SyntaxError: y"]), "5",
             rng.choice([None, "5"]), rng.choice([1.0, 61.0])) for i in range(first, last)]


def test_each_file_is_graded_once(spark, frame, tmp_path):
    arrivals, out, state = [str(tmp_path / n) for n in ("in", "out", "state")]
    frame(some_runs(0, 40), RUNS).write.parquet(arrivals)

    def run():
        stream = spark.readStream.schema(RUNS).parquet(arrivals)
        start_grading(stream, out, state, integer_guard=True).awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 40
    assert run().count() == 40
    frame(some_runs(40, 55), RUNS).write.mode("append").parquet(arrivals)
    streamed = run().select("row_no", "status", "output")
    batch = graded(spark.read.parquet(arrivals), True).select("row_no", "status", "output")
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert streamed.count() == 55


def test_leaderboard_equals_batch_with_late_and_repeated_attempts(spark, frame, tmp_path):
    arrivals, out, state = [str(tmp_path / n) for n in ("in", "out", "state")]
    rows = random_attempts(11)
    random.Random(12).shuffle(rows)
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third] + rows[:5], rows[2 * third :]]
    for number, batch in enumerate(batches):
        # An earlier pass may arrive late and an attempt twice.
        table = frame(batch, SCHEMA).coalesce(1)
        table.write.mode("append").parquet(arrivals)
        stream = (
            spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrivals)
        )
        start_leaderboard(stream, 3, out, state).awaitTermination()
        so_far = [r for b in batches[: number + 1] for r in b]
        expected = best_of_k_accuracy(frame(so_far, SCHEMA), 3)
        found = read_leaderboard(spark, out).select(*expected.columns)
        assert sorted(found.collect()) == sorted(expected.collect())


TIMED = "row_no long, stdout string, stderr string, solution string, duration_s double, ended_at timestamp"
ANSWERS = "row_no long, text string, answered_at timestamp"


def hour(h):
    return datetime(2024, 1, 1) + timedelta(hours=h)


class Arrivals:
    """Two growing tables and the stream over both, started anew for each arrival."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.add("runs", [], TIMED)
        self.add("answers", [], ANSWERS)

    def add(self, name, rows, schema):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def table(self, name):
        return self.spark.read.schema(TIMED if name == "runs" else ANSWERS).parquet(f"{self.folder}/{name}")

    def run(self):
        sources = [self.spark.readStream.schema(x).parquet(f"{self.folder}/{n}") for n, x in (("runs", TIMED), ("answers", ANSWERS))]
        self.query = start_joined_grading(*sources, f"{self.folder}/out", f"{self.folder}/state", Patience("10 hours", "1 hour"))
        self.query.awaitTermination()
        out = self.spark.read.parquet(f"{self.folder}/out")
        return {r.row_no: (r.status, r.output) for r in out.collect()}

    def close(self, at):
        for name, time in (("runs", "ended_at"), ("answers", "answered_at")):
            closing_rows(self.spark, time, self.table(name), at).write.mode("append").parquet(f"{self.folder}/{name}")


def test_answers_that_come_files_later(spark, tmp_path):
    here = Arrivals(spark, str(tmp_path))
    here.add("runs", [(1, "5", "", "5", 1.0, hour(0)), (2, "6", "", "5", 1.0, hour(0)), (3, "7", "", "5", 1.0, hour(0)),
                      (4, "x", "E", "5", 1.0, hour(1)), (5, "5", "", "5", 90.0, hour(1))], TIMED)
    settled = {1: ("no_error", "5"), 4: ("runtime_error", "x"), 5: ("timeout_error", "")}
    assert here.run() == settled
    here.add("runs", [(6, "9", "", "9", 1.0, hour(6)), (7, "8", "", "9", 1.0, hour(6))], TIMED)
    assert here.run() == settled | {6: ("no_error", "9")}
    # Two answers to one run: the run has one verdict. One answer has no run to wait for.
    here.add("answers", [(2, " 5 ", hour(9)), (2, " 5 ", hour(9)), (99, "5", hour(9))], ANSWERS)
    so_far = settled | {6: ("no_error", "9"), 2: ("no_error", "5")}
    assert here.run() == so_far
    assert here.run() == so_far
    # Later rows in both streams tell that no answer to run 3 or 7 can come; they leave the state.
    here.add("runs", [(8, "1", "", "2", 1.0, hour(60))], TIMED)
    here.add("answers", [(50, "5", hour(60))], ANSWERS)
    assert here.run() == so_far | {3: ("wrong_output", "7"), 7: ("wrong_output", "8")}
    held = sum(op["numRowsTotal"] for op in here.query.lastProgress["stateOperators"] if op["operatorName"].startswith("symmetric"))
    assert held <= 2
    assert missed(here.table("runs"), spark.read.parquet(f"{here.folder}/out"), "2024-01-02").count() == 0
    here.close("2024-02-01")
    assert here.run() == so_far | {3: ("wrong_output", "7"), 7: ("wrong_output", "8"), 8: ("wrong_output", "1")}


def test_runs_that_come_too_late_are_found(spark, tmp_path):
    here = Arrivals(spark, str(tmp_path))
    for at in (0, 50):
        here.add("runs", [(at, "1", "", "2", 1.0, hour(at))], TIMED)
        here.add("answers", [(1000 + at, "5", hour(at))], ANSWERS)
        here.run()
    here.add("runs", [(7, "1", "", "2", 1.0, hour(2)), (8, "2", "", "2", 1.0, hour(2))], TIMED)
    found = here.run()
    late = missed(here.table("runs"), spark.read.parquet(f"{here.folder}/out"), "2024-01-02")
    assert {r.row_no for r in late.collect()} == {0, 7, 8} - found.keys()
    assert 7 not in found


def test_the_sessions_state_setting_returns(spark, tmp_path):
    before = spark.conf.get(PROVIDER)
    with state_on_disk(spark):
        assert spark.conf.get(PROVIDER) == ROCKSDB
    assert spark.conf.get(PROVIDER) == before


def test_state_has_parts_for_the_cores(spark, tmp_path):
    before = spark.conf.get(PARTITIONS)
    try:
        spark.conf.set(PARTITIONS, 5000)
        with state_on_disk(spark):
            parts = int(spark.conf.get(PARTITIONS))
        assert spark.sparkContext.defaultParallelism <= parts < 5000
        assert spark.conf.get(PARTITIONS) == "5000"
        spark.conf.set(PARTITIONS, 2)
        with state_on_disk(spark):
            assert spark.conf.get(PARTITIONS) == "2"
    finally:
        spark.conf.set(PARTITIONS, before)


def test_a_joined_stream_keeps_one_store_a_partition(spark, tmp_path):
    """What a batch costs for each store follows their number: one for the join and one for the answers."""
    here = Arrivals(spark, str(tmp_path))
    here.add("runs", [(1, "6", "", "5", 1.0, hour(0))], TIMED)
    here.add("answers", [(1, "5", hour(1))], ANSWERS)
    assert here.run() == {1: ("no_error", "5")}
    for operator in here.query.lastProgress["stateOperators"]:
        assert operator["numStateStoreInstances"] == operator["numShufflePartitions"] > 0


def test_leaderboard_batch_run_again_counts_once(spark, frame, tmp_path):
    out = str(tmp_path / "out")
    changes = "model string, " + ", ".join(f"{c} long" for c in COUNTS)
    first = frame([("a", 2, 1, 1, 1, 1, 0), ("b", 1, 0, 1, 0, 0, 0)], changes)
    second = frame([("a", 0, 1, 0, 0, 0, 1), ("c", 2, 0, 1, 1, 0, 0)], changes)
    add_changes(spark, first, out, 0)
    for _ in range(2):
        add_changes(spark, second, out, 1)
    # A batch that failed on the way left a folder without a mark.
    second.write.parquet(f"{out}/version-2-broken")
    found = {r.model: (r.total, r.solved, r.solved_part2) for r in read_leaderboard(spark, out).collect()}
    assert found == {"a": (2, 2, 1), "b": (1, 0, 0), "c": (2, 0, 0)}


def test_a_batch_reads_its_new_rows_only(spark, frame, tmp_path):
    """The second batch brings few rows; the stream reads those and the models of the version before."""
    arrivals, out, state = [str(tmp_path / n) for n in ("in", "out", "state")]
    rows = random_attempts(21)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(arrivals)
        query = start_leaderboard(stream, 3, out, state)
        query.awaitTermination()
        return query.lastProgress

    frame(rows[:-7], SCHEMA).coalesce(1).write.parquet(arrivals)
    run()
    frame(rows[-7:], SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
    progress = run()
    assert progress["numInputRows"] == 7
    assert progress["stateOperators"][0]["numRowsUpdated"] <= 7
    expected = best_of_k_accuracy(frame(rows, SCHEMA), 3)
    assert sorted(read_leaderboard(spark, out).select(*expected.columns).collect()) == sorted(expected.collect())


def test_leaderboard_state_follows_the_years_of_models(spark, frame, tmp_path):
    """The days of a year share an entry and a call; null days, years and models count as in a grouping."""
    arrivals, out, state = [str(tmp_path / n) for n in ("in", "out", "state")]
    rng = random.Random(31)
    rows = random_attempts(31)
    model, year, day = (SCHEMA.split(", ").index(c) for c in ("model string", "year int", "day int"))
    rows = [tuple(None if i in (model, year, day) and rng.random() < 0.1 else x for i, x in enumerate(r)) for r in rows]
    frame(rows, SCHEMA).coalesce(1).write.parquet(arrivals)
    query = start_leaderboard(spark.readStream.schema(SCHEMA).parquet(arrivals), 3, out, state)
    query.awaitTermination()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held <= len({(r[model], r[year]) for r in rows})
    expected = best_of_k_accuracy(frame(rows, SCHEMA), 3)
    found = read_leaderboard(spark, out).select(*expected.columns)
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)
