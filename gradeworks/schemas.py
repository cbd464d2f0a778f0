"""Schemas of the engine's inputs. Answers and solutions always stay strings."""

from pyspark.sql import types as T

PART = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("converted_description", T.StringType()),
    ]
)

CHALLENGE = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("part1", PART),
        T.StructField("part2", PART),
        T.StructField("input", T.StringType()),
    ]
)

FLAT_CHALLENGE = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("part1", T.StringType()),
        T.StructField("part1_converted", T.StringType()),
        T.StructField("part1_solution", T.StringType()),
        T.StructField("part2", T.StringType()),
        T.StructField("part2_converted", T.StringType()),
        T.StructField("part2_solution", T.StringType()),
        T.StructField("input", T.StringType()),
    ]
)

PROBLEM = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("solution", T.StringType()),
        T.StructField("story", T.StringType()),
    ]
)

FLAT_PROBLEM = T.StructType(
    [
        T.StructField("story_problem" if f.name == "story" else f.name, f.dataType)
        for f in PROBLEM.fields
    ]
)

RESULT_TWO_PART = T.StructType(
    [
        T.StructField("row_no", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("expected_output", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("kpass", T.DoubleType()),
    ]
)

RESULT_MATH = T.StructType(
    [
        T.StructField("row_no", T.LongType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("expected_output", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("difficulty", T.StringType()),
    ]
)

def _result_list(keys: dict[str, T.DataType]) -> T.StructType:
    """The lists of a run as they are kept: keys, chosen pass, status, and which list it is."""
    chosen = {"kpass": T.IntegerType(), "status": T.StringType(), "row_no": T.LongType()}
    lists = {"k": T.IntegerType(), "subset": T.StringType()}
    columns = {"model": T.StringType()} | keys | chosen | lists
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RESULT_LIST_TWO_PART = _result_list({name: T.IntegerType() for name in ("year", "day", "part")})
RESULT_LIST_MATH = _result_list({"id": T.IntegerType()})

DOC_KEYS = ["year", "day"]
PART_KEYS = ["year", "day", "part"]
TASK_KEYS = ["model", "year", "day", "part"]
PROBLEM_KEYS = ["model", "id"]
