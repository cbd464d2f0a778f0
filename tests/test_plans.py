"""Physical plans of all queries: what must not appear in them."""

import pytest

from conftest import SMALL
from gradeworks.catalog.registry import all_queries

QUERIES = all_queries()
NEED_WINDOW = {"overall_score"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name):
    result = QUERIES[name].run(spark, SMALL)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "EvalPython" not in plan
    assert name in NEED_WINDOW or "Window [" not in plan


def test_reports_do_not_read_texts(spark):
    plan = QUERIES["accuracy_t"].run(spark, SMALL)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    schema = text[text.index("ReadSchema: ") :].split("\n")[0]
    assert "props" not in schema and "value" not in schema
    assert "SortAggregate" not in text


def test_range_filters_reach_the_scan(spark, tmp_path):
    from gradeworks.operators.tasks import TaskSpan, in_range

    rows = spark.createDataFrame([(2015, 1, 1, "x"), (2016, 2, 1, "y")],
                                 "year int, day int, part int, text string")
    rows.write.partitionBy("year").parquet(str(tmp_path / "t"))
    found = in_range(spark.read.parquet(str(tmp_path / "t")), TaskSpan((2016, 2016), (2, 2)))
    plan = found.select("part")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "GreaterThanOrEqual(day,2)" in plan or "EqualTo(day,2)" in plan


def final_plan(result):
    """The plan as it ran, after adaptive execution."""
    result.collect()
    return result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_stored_table_is_gated_without_a_shuffle(spark):
    """Buckets by day serve all of selection and gating; only the chosen numbers are sent around."""
    plan = final_plan(QUERIES["stored_gated"].run(spark, SMALL))
    assert "Bucketed: true" in plan
    assert "Exchange hashpartitioning" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["dedup_first", "dedup_last", "dedup_first_composite", "assemble_nested"])
def test_copies_are_chosen_by_numbers(spark, name):
    """No whole row is in an aggregation buffer, which would sort; those not kept are not shuffled."""
    assert "SortAggregate" not in final_plan(QUERIES[name].run(spark, SMALL))


@pytest.mark.parametrize("name", ["dedup_last", "early_stop", "provider_failures", "chat_prompt_p2"])
def test_rows_meet_sparse_values_where_they_are(spark, name):
    plan = final_plan(QUERIES[name].run(spark, SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_the_answer_is_searched_once(spark):
    result = QUERIES["grade_direct"].run(spark, SMALL)
    optimized = result._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count(r"(?<!\p{Nd})(\p{Nd}+)") == 1
    assert optimized.count("Relation [") == 2  # the answers, and their re-extracted texts


@pytest.mark.parametrize("name", ["grade_t", "grade_m"])
def test_runs_are_read_once(spark, name):
    optimized = QUERIES[name].run(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Relation [") == 2
