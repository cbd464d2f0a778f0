"""Every registered query against its SQL, over whole tables."""

import math

import pytest

import __spark_entry__ as entry_points
from conftest import SMALL
from gradeworks.catalog.registry import all_queries

QUERIES = all_queries()


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, tables, name):
    query = QUERIES[name]
    result = query.run(spark, SMALL)
    found = _rows(result.columns, result.collect())
    check = tables.execute(query.sql)
    columns = [c[0] for c in check.description]
    assert sorted(result.columns) == sorted(columns)
    assert found == _rows(columns, check.fetchall())


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
