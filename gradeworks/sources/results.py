"""Results files: CSV with source code in its fields, and names that carry the run."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.fixed_values import (
    ALIAS_NAME,
    ALIAS_WORD,
    MATH,
    PLAIN_VARIANT,
    REPORT_SUBSETS,
    TWO_PART,
    VARIANT_NAMES,
)
from gradeworks.schemas import RESULT_MATH, RESULT_TWO_PART
from gradeworks.sources.trees import packed

# Fields hold newlines, quotes and blanks that must come back unchanged.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

# An exported corpus tells an absent field from an empty one, as the empty last answers.
EXPORT_OPTIONS = {**CSV_OPTIONS, "sep": "\t", "nullValue": "\\N"}

# Fixed pattern of a results file name, model-subset[_variant]-pass@k.csv: three fields, no
# more, and a known subset.
RESULT_NAME = (
    rf"(?:^|/)([^/-]+)-({TWO_PART}|{MATH})(?:_([^/_-]*))?-[^/@-]*@([0-9]{{1,9}})\.csv$"
)


def read_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of results files with their file path.

    The unnamed first column is the row order and becomes ``row_no``. A quoted field may
    run over lines, so a file is read by one task: convert to parquet (``write_results``)
    before large work.
    """
    schemas = {TWO_PART: RESULT_TWO_PART, MATH: RESULT_MATH}
    if kind not in schemas:
        raise ValueError(f"unknown results kind {kind}")
    rows = (
        spark.read.options(**CSV_OPTIONS, enforceSchema=True, recursiveFileLookup=True)
        .options(pathGlobFilter="*.csv")
        .schema(schemas[kind])
        .csv(path)
    )
    rows = packed(rows.withColumn("path", F.col("_metadata.file_path")), path)
    return rows.withColumn("kpass", F.col("kpass").cast("int")) if kind == TWO_PART else rows


def is_result_file(path: Column) -> Column:
    """The path names a results file of a known subset."""
    return path.rlike(RESULT_NAME)


def parse_result_name(rows: DataFrame, path_column: str = "path") -> DataFrame:
    """Adds model, subset, variant and k from the file name.

    The model comes from the name, not from the folder. Any other name gets nulls.
    """
    path = F.col(path_column)
    field = lambda i: F.nullif(F.regexp_extract(path, RESULT_NAME, i), F.lit(""))
    variant = F.when(field(3).isNull(), F.when(field(2).isNotNull(), PLAIN_VARIANT))
    for name, label in VARIANT_NAMES.items():
        variant = variant.when(field(2) == name, label)
    return rows.withColumns(
        {"model": field(1), "subset": field(2), "variant": variant, "k": field(4).cast("int")}
    )


def model_alias(folder: Column) -> Column:
    """Model name used in file names, from the name of the model's folder."""
    return F.when(folder.contains(ALIAS_WORD), ALIAS_NAME).otherwise(
        F.replace(folder, F.lit("-"), F.lit("_"))
    )


def report_files(rows: DataFrame, path_column: str = "path", k: int = 3) -> DataFrame:
    """Rows of the files an error report reads: expected name in a model's folder.

    Adds the folder as ``model`` and the report's ``subset``. Any other file is left out.
    """
    ending = f"-pass@{k}.csv"
    path = F.col(path_column)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.substring_index(path, "/", -1)
    start = F.concat(model_alias(folder), F.lit("-"))
    endings = [f"{subset}{ending}" for subset in REPORT_SUBSETS]
    rest = F.substr(name, F.length(start) + 1)
    is_wanted = path.endswith(ending) & name.startswith(start) & rest.isin(endings)
    return rows.where(is_wanted).withColumns(
        {"model": folder, "subset": F.left(rest, F.length(rest) - len(ending))}
    )


def scan_results(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All result rows of one subset below a folder, with the run taken from the names."""
    files = read_results(spark, root, kind).where(is_result_file(F.col("path")))
    return parse_result_name(files).where(F.col("subset") == kind)


def scan_all_results(spark: SparkSession, root: str) -> DataFrame:
    """The rows of both subsets below a folder; keys of the other kind are null."""
    two_part, math = [scan_results(spark, root, kind) for kind in (TWO_PART, MATH)]
    return two_part.unionByName(math, allowMissingColumns=True)
