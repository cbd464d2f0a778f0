import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    """The given tables as DuckDB views, under their own names."""
    connection = duckdb.connect()
    for name in os.listdir(SMALL):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{name}'")
    return connection


@pytest.fixture
def frame(spark):
    """Builds a small DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def evaluate(spark):
    """Values of a function of one string column, in the order of the texts."""

    def run(expression, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        found = rows.select("i", expression(rows.t).alias("v")).collect()
        return [row.v for row in sorted(found, key=lambda r: r.i)]

    return run
