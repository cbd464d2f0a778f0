"""Snapshots: segments are replaced, versions stay, a failed save leaves the last one."""

import pytest
from pyspark.sql import functions as F

from gradeworks.schemas import RESULT_LIST_MATH, RESULT_LIST_TWO_PART
from gradeworks.sources.snapshots import by_id_range, by_year, read_snapshot, save_snapshot
from gradeworks.sources.versions import current_version, publish, read_version


def days(frame, *rows):
    return frame([("m", year, day, 1, 0, status, None, 3, "aoc") for year, day, status in rows], RESULT_LIST_TWO_PART)


def held(spark, root, version=None):
    rows = read_snapshot(spark, root, RESULT_LIST_TWO_PART, version)
    return sorted((r.year, r.day, r.status) for r in rows.collect())


def test_changed_years_are_replaced(spark, frame, tmp_path):
    root = str(tmp_path)
    assert held(spark, root) == []
    assert save_snapshot(days(frame, (2015, 1, "a"), (2015, 2, "a"), (2016, 1, "a")), root, by_year()) == 0
    assert save_snapshot(days(frame, (2016, 5, "b"), (2017, 1, "b")), root, by_year()) == 1
    assert held(spark, root) == [(2015, 1, "a"), (2015, 2, "a"), (2016, 5, "b"), (2017, 1, "b")]
    assert held(spark, root, 0) == [(2015, 1, "a"), (2015, 2, "a"), (2016, 1, "a")]


def test_a_year_without_rows_is_emptied_only_if_covered(spark, frame, tmp_path):
    root = str(tmp_path)
    save_snapshot(days(frame, (2015, 1, "a"), (2016, 1, "a")), root, by_year())
    save_snapshot(days(frame), root, by_year())
    assert len(held(spark, root)) == 2
    save_snapshot(days(frame), root, by_year(), covered=[2016])
    assert held(spark, root) == [(2015, 1, "a")]


def test_a_failed_save_leaves_the_old_version(spark, frame, tmp_path):
    root = str(tmp_path)
    save_snapshot(days(frame, (2015, 1, "a"), (2016, 1, "a")), root, by_year())
    broken = days(frame, (2015, 9, "b"), (2016, 9, "b")).withColumn(
        "status", F.when(F.col("year") == 2016, F.raise_error(F.lit("lost"))).otherwise(F.col("status"))
    )
    with pytest.raises(Exception, match="lost"):
        save_snapshot(broken, root, by_year())
    assert held(spark, root) == [(2015, 1, "a"), (2016, 1, "a")]
    save_snapshot(days(frame, (2016, 9, "c")), root, by_year())
    assert held(spark, root) == [(2015, 1, "a"), (2016, 9, "c")]


def test_rows_without_a_year_have_a_segment(spark, frame, tmp_path):
    root = str(tmp_path)
    save_snapshot(days(frame, (None, 1, "a"), (2016, 1, "a")), root, by_year())
    save_snapshot(days(frame, (None, 2, "b")), root, by_year())
    rows = read_snapshot(spark, root, RESULT_LIST_TWO_PART).collect()
    assert {(r.year, r.day, r.status) for r in rows} == {(None, 2, "b"), (2016, 1, "a")}


def test_ranges_of_problems(spark, frame, tmp_path):
    root = str(tmp_path)

    def problems(*rows):
        return frame([("m", i, 0, s, 1, 3, "euler") for i, s in rows], RESULT_LIST_MATH)

    save_snapshot(problems((5, "a"), (15, "a"), (25, "a")), root, by_id_range(10))
    save_snapshot(problems((11, "b"), (25, "b")), root, by_id_range(10))
    found = read_snapshot(spark, root, RESULT_LIST_MATH).collect()
    assert sorted((r.id, r.status) for r in found) == [(5, "a"), (11, "b"), (25, "b")]


def test_only_listed_folders_are_read(spark, frame, tmp_path):
    root = str(tmp_path)
    save_snapshot(days(frame, (2015, 1, "a"), (2016, 1, "a")), root, by_year())
    save_snapshot(days(frame, (2016, 2, "b")), root, by_year())
    plan = read_snapshot(spark, root, RESULT_LIST_TWO_PART)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws(/, _save" in plan


def test_versions_are_seen_once_complete(spark, frame, tmp_path):
    root = str(tmp_path)
    assert current_version(spark, root) is None
    publish(frame([(1,)], "a int"), root, 0)
    publish(frame([(2,)], "a int"), root, 0)
    assert [r.a for r in read_version(spark, root, 0).collect()] == [1]
    with pytest.raises(ValueError):
        read_version(spark, root, 1)
