"""A registered query, and views that read the given tables as the engine's inputs."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A named query over the tables in a folder, and the SQL that must agree with it."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


@dataclass(frozen=True)
class View:
    """Row-wise derivation of an engine input from one given table.

    The expressions are read alike by Spark and by the SQL check. They use neither windows
    nor joins, so a view costs one scan however large the table is.
    """

    table: str
    columns: dict[str, str]
    where: str | None = None

    def select(self, rows: DataFrame) -> DataFrame:
        kept = rows.where(self.where) if self.where else rows
        return kept.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.select(spark.read.parquet(f"{folder}/{self.table}.parquet"))

    def stream(self, spark: SparkSession, folder: str) -> DataFrame:
        """The table's files as they arrive; a pattern may also match a single file."""
        schema = spark.read.parquet(f"{folder}/{self.table}.parquet").schema
        files = f"{folder}/{{{self.table}.parquet}}"
        return self.select(spark.readStream.schema(schema).parquet(files))

    @property
    def sql(self) -> str:
        items = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        condition = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {items} FROM {self.table}{condition}"
