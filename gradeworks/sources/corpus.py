"""Readers of the challenge corpus and of raw puzzle documents."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.fixed_values import MATH, TWO_PART
from gradeworks.operators.tasks import TaskSpan, flatten_parts
from gradeworks.schemas import CHALLENGE, DOC_KEYS, FLAT_CHALLENGE, FLAT_PROBLEM, PROBLEM
from gradeworks.sources.results import EXPORT_OPTIONS
from gradeworks.sources.trees import folder_uri, listed, packed, read_listed, year_folders

CORRUPT = "_corrupt_record"

DAY_FILES = "day_*.json"

# Fixed patterns of corpus paths: <year>/day_<day>.json and <year>/day_<day>_part<part>.md
CHALLENGE_PATH = r"([0-9]+)/day_([0-9]+)\.json$"
DOCUMENT_PATH = r"([0-9]+)/[^/_]*_([0-9]+)_(?:part)?([0-9]+)(?:\.md)?$"


def challenge_keys(path: Column) -> dict[str, Column]:
    """Year and day from the path of a challenge file; null where it has none."""
    return {
        "year": F.regexp_extract(path, CHALLENGE_PATH, 1).try_cast("int"),
        "day": F.regexp_extract(path, CHALLENGE_PATH, 2).try_cast("int"),
    }


def document_keys(path: Column) -> dict[str, Column]:
    """Year, day and part from the path of a raw part file; null where it has none."""
    return {
        name: F.regexp_extract(path, DOCUMENT_PATH, i + 1).try_cast("int")
        for i, name in enumerate(["year", "day", "part"])
    }


def read_nested_challenges(
    spark: SparkSession,
    root: str,
    strict: bool = False,
    one_file_per_day: bool = True,
    span: TaskSpan | None = None,
) -> DataFrame:
    """Nested challenge records; a record that does not parse has its text in CORRUPT.

    With a ``span``, folders of other years are not listed, and files of other days are left out by
    their paths before they are read.

    ``one_file_per_day`` reads the tree ``<year>/day_<day>.json`` and takes the keys from
    the path. Otherwise the folder holds JSON lines with the keys inside, which split
    across tasks. ``strict`` stops at the first bad record. The listing is recursive
    rather than a glob, which would start one listing task per file. A whole tree with many
    years is listed and read by tasks, so that no listing of all files comes to the driver.
    """
    # Some writers put year and day in quotes; as text both spellings are read.
    fields = [
        T.StructField(f.name, T.StringType()) if f.name in DOC_KEYS else f
        for f in CHALLENGE.fields
    ]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    options = {
        "mode": "FAILFAST" if strict else "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }
    texts = _large_tree(spark, root) if one_file_per_day and span is None else None
    if texts is None:
        reader = spark.read.option("recursiveFileLookup", True)
        if one_file_per_day:
            reader = reader.option("pathGlobFilter", DAY_FILES)
        roots = year_folders(spark, root, span.years) if span and one_file_per_day else [root]
        texts = reader.text(roots, wholetext=one_file_per_day)
        if one_file_per_day:
            texts = packed(_within(texts, challenge_keys(F.col("_metadata.file_path")), span), *roots)
        else:
            texts = texts.where("trim(value) <> ''")
        texts = texts.select("value", F.col("_metadata.file_path").alias("path"))
    records = texts.select("value", "path", F.from_json("value", schema, options).alias("record"))
    keys = {name: F.col(f"record.{name}").try_cast("int") for name in DOC_KEYS}
    if one_file_per_day:
        keys = challenge_keys(F.col("path"))
    # Text without any JSON value yields no record; the text itself is then the bad record.
    corrupt = F.when(F.col("record").isNull(), F.col("value")).otherwise(
        F.col(f"record.{CORRUPT}")
    )
    return records.select(
        *[key.alias(name) for name, key in keys.items()],
        "record.part1",
        "record.part2",
        "record.input",
        corrupt.alias(CORRUPT),
    )


def _large_tree(spark: SparkSession, root: str) -> DataFrame | None:
    """Whole texts and paths of a tree that tasks list; None where Spark's reader serves."""
    uri = folder_uri(spark, root)
    files = listed(spark, uri, DAY_FILES) if uri else None
    return None if files is None else read_listed(files, uri)


def _within(files: DataFrame, keys: dict[str, Column], span: TaskSpan | None) -> DataFrame:
    """The files whose path lies in the span."""
    if span is None:
        return files
    return files.where(keys["year"].between(*span.years) & keys["day"].between(*span.days))


def read_challenges(
    spark: SparkSession,
    root: str,
    strict: bool = False,
    one_file_per_day: bool = True,
    span: TaskSpan | None = None,
) -> DataFrame:
    """The flat challenge table; records that do not parse are left to ``quarantined``."""
    records = read_nested_challenges(spark, root, strict, one_file_per_day, span)
    return flatten_parts(records.where(F.col(CORRUPT).isNull()))


def quarantined(records: DataFrame) -> DataFrame:
    """Records that did not parse, with their text in CORRUPT."""
    return records.where(F.col(CORRUPT).isNotNull())


def read_problems(spark: SparkSession, root: str, one_array_per_file: bool = True) -> DataFrame:
    """Math problems from files that each hold a JSON array, or from JSON lines."""
    rows = (
        spark.read.schema(PROBLEM)
        .option("multiLine", one_array_per_file)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
        .withColumnRenamed("story", "story_problem")
    )
    return packed(rows, root) if one_array_per_file else rows


def read_subset(spark: SparkSession, name: str, root: str, lite_root: str | None = None):
    """The corpus of a subset. ``lite_root`` is used where the two-part root is absent."""
    if name == MATH:
        return read_problems(spark, root)
    if name != TWO_PART:
        raise ValueError(f"unknown subset {name}")
    try:
        return read_challenges(spark, root)
    except AnalysisException as error:
        if lite_root is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_challenges(spark, lite_root)


def read_documents(spark: SparkSession, root: str, span: TaskSpan | None = None) -> DataFrame:
    """Raw part files as one row each: path keys and the whole text; those in the span."""
    roots = year_folders(spark, root, span.years) if span else [root]
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .text(roots, wholetext=True)
        .withColumnRenamed("value", "text")
    )
    keys = document_keys(F.col("_metadata.file_path"))
    return packed(_within(files, keys, span).withColumns(keys), *roots)


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A corpus exported by ``write_export``, with its declared types."""
    schema = {TWO_PART: FLAT_CHALLENGE, MATH: FLAT_PROBLEM}[kind]
    return spark.read.options(**EXPORT_OPTIONS).schema(schema).csv(path)
