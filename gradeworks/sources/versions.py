"""Tables that change by whole versions: a reader sees the last complete one, never half of one.

A version is a folder of its own. It counts once its mark is there: an empty file, which every
file system makes at once or not at all. The current version is that of the highest mark. Data of
a write that failed has no mark and is never read.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_MARKS = "_published"


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _marks(spark: SparkSession, root: str) -> dict[int, str]:
    """The folder of each published version."""
    files, place = _place(spark, f"{root}/{_MARKS}")
    if not files.exists(place):
        return {}
    names = [status.getPath().getName().split("=") for status in files.listStatus(place)]
    return {int(number): folder for number, folder in names}


def current_version(spark: SparkSession, root: str) -> int | None:
    """The number of the last complete version, if there is one."""
    return max(_marks(spark, root), default=None)


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """A published version."""
    marks = _marks(spark, root)
    if version not in marks:
        raise ValueError(f"no version {version} below {root}")
    return spark.read.parquet(f"{root}/{marks[version]}")


def publish(table: DataFrame, root: str, version: int) -> None:
    """Writes a version and marks it. A version that is there already stays as it is."""
    spark = table.sparkSession
    if version in _marks(spark, root):
        return
    folder = f"version-{version}-{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/{folder}")
    files, mark = _place(spark, f"{root}/{_MARKS}/{version}={folder}")
    files.create(mark, False).close()
