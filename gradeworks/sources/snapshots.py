"""Snapshots of a run's results so far: both lists, saved piece by piece while the run goes on.

Results are cut into segments, years of the two-part subset or ranges of problem ids. A save
writes the segments that changed into a folder of its own and publishes a list of which segment
stands in which folder: unchanged segments are named again, not copied. Readers follow the last
published list, so a save that fails, or is still going on, leaves the snapshot as it was, and
every earlier version can still be read.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.sources.versions import current_version, publish, read_version

ID_RANGE = 1000

_SEGMENT, _SAVE = "_segment", "_save"


def by_year() -> Column:
    """Segments of two-part results."""
    return F.col("year")


def by_id_range(size: int = ID_RANGE) -> Column:
    """Segments of math results: ranges of so many problem ids."""
    return F.floor(F.col("id") / size)


def _named(segment: Column) -> Column:
    return F.coalesce(segment.cast("string"), F.lit("none")).alias(_SEGMENT)


def save_snapshot(
    results: DataFrame, root: str, segment: Column, covered: list[int] | None = None
) -> int:
    """Replaces the segments that ``results`` has rows of, and returns the new version.

    ``covered`` names further segments the run went over: without rows they are empty now.
    """
    spark = results.sparkSession
    save = uuid.uuid4().hex
    folder = f"{root}/data/{_SAVE}={save}"
    results.withColumn(_SEGMENT, _named(segment)).write.partitionBy(_SEGMENT).parquet(folder)
    shape = T.StructType([T.StructField(_SEGMENT, T.StringType())])
    written = spark.read.schema(shape).parquet(folder).select(_SEGMENT).distinct()
    listed = written.withColumn(_SAVE, F.lit(save))
    version = current_version(spark, root)
    if version is not None:
        replaced = written
        if covered:
            replaced = written.union(spark.createDataFrame([(str(c),) for c in covered], f"{_SEGMENT} string"))
        kept = read_version(spark, root, version).join(replaced, _SEGMENT, "left_anti")
        listed = kept.unionByName(listed)
    publish(listed, root, 0 if version is None else version + 1)
    return 0 if version is None else version + 1


def read_snapshot(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    version: int | None = None,
    segments: list[str] | None = None,
) -> DataFrame:
    """The rows of the last published version, or of the one named; none before the first save.

    The list has a row for each segment; folders that are not on it, or not among ``segments``, are
    not read.
    """
    if version is None:
        version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    listed = read_version(spark, root, version)
    if segments is not None:
        listed = listed.where(F.col(_SEGMENT).isin(["none" if s == "None" else s for s in segments]))
    places = [f"{row[_SAVE]}/{row[_SEGMENT]}" for row in listed.collect()]
    whole = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in (_SAVE, _SEGMENT)]])
    rows = spark.read.schema(whole).parquet(f"{root}/data")
    here = F.concat_ws("/", _SAVE, _SEGMENT).isin(places)
    return rows.where(here).select(*[f.name for f in schema.fields])
