"""Queries that write whole trees of files, as other tools lay them out, and read them back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query, View
from gradeworks.catalog.tasks import FLAT, nested
from gradeworks.operators.tasks import TaskSpan
from gradeworks.session import new_table_path
from gradeworks.sources import corpus as C
from gradeworks.sources.results import scan_all_results
from gradeworks.sources.trees import one_line_files, write_tree

PROBLEMS_A_FILE = 20
SPAN = TaskSpan((2016, 2030), (2, 24))

# Raw part files, one for each document.
PART_TEXTS = View(
    "documents",
    {
        "year": V.CHALLENGES.columns["year"],
        "day": V.CHALLENGES.columns["day"],
        "part": "cast(1 + floor(doc_id / 3) % 2 AS int)",
        "text": "concat(coalesce(text, ''), chr(10))",
    },
)


def _named(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _challenge_tree(s, d) -> str:
    root = new_table_path(s, "challenge-tree")
    rows = nested(s, d)
    path = _named(F.col("year"), "/day_", F.col("day"), ".json")
    write_tree(one_line_files(rows, path, F.to_json(F.struct(*rows.columns))), root)
    return root


def _problem_tree(s, d):
    """Files of some problems each, as arrays."""
    root = new_table_path(s, "problem-tree")
    rows = V.PROBLEMS.frame(s, d)
    path = _named("part_", F.floor(F.col("id") / PROBLEMS_A_FILE), ".json")
    items = F.sort_array(F.collect_list(F.struct("id", F.struct(*rows.columns).alias("item"))))
    arrays = rows.groupBy(path.alias("path")).agg(F.to_json(F.transform(items, lambda x: x["item"])).alias("text"))
    write_tree(one_line_files(arrays, F.col("path"), F.col("text")), root)
    return C.read_problems(s, root)


def _csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of results files, the header first; the unnamed first column is the row order."""
    fields = F.struct(F.col("row_no").alias("_c0"), *columns)
    line = F.concat(F.to_csv(fields, {"quote": '"', "escape": '"', "emptyValue": ""}), F.lit("\n"))
    path = F.ltrim(F.col("path"), F.lit("/")).alias("path")
    lines = rows.select(path, F.col("row_no").alias("place"), line.alias("line"))
    header = F.lit("," + ",".join(columns) + "\n").alias("line")
    return lines.unionByName(rows.select(path, F.lit(-1).cast("long").alias("place"), header).distinct())


_TEXTS = ["output", "expected_output", "error", "code"]


def _results_tree(s, d):
    """A results file of each run, both kinds in one tree, with names the scan leaves out."""
    root = new_table_path(s, "results-tree")
    rows = V.RESULT_FILES.frame(s, d)
    texts = {n: F.concat(F.lit(f'{n}, "of" '), F.col("row_no").cast("string")) for n in _TEXTS}
    rows = rows.withColumns(texts | {"kpass": F.lit(0.0), "difficulty": F.lit("5")})
    two_part = _csv_lines(rows.where("id IS NULL"), ["year", "day", "part", "status", *_TEXTS, "kpass"])
    math = _csv_lines(rows.where("id IS NOT NULL"), ["id", "status", *_TEXTS, "difficulty"])
    write_tree(two_part.unionByName(math), root)
    found = scan_all_results(s, root)
    return found.select("model", "subset", "variant", "k", "row_no", "year", "day", "part", "id", "status", "code")


def _document_tree(s, d):
    root = new_table_path(s, "document-tree")
    rows = PART_TEXTS.frame(s, d)
    path = _named(F.col("year"), "/day_", F.col("day"), "_part", F.col("part"), ".md")
    write_tree(one_line_files(rows, path, F.col("text")), root)
    return C.read_documents(s, root, SPAN).select("year", "day", "part", "text")


_IN_SPAN = f"year BETWEEN {SPAN.years[0]} AND {SPAN.years[1]} AND day BETWEEN {SPAN.days[0]} AND {SPAN.days[1]}"

QUERIES = [
    Query(
        "challenge_tree",
        lambda s, d: C.read_challenges(s, _challenge_tree(s, d)),
        f"SELECT {FLAT} FROM ({V.CHALLENGES.sql})",
    ),
    Query(
        "challenge_tree_span",
        lambda s, d: C.read_challenges(s, _challenge_tree(s, d), span=SPAN),
        f"SELECT {FLAT} FROM ({V.CHALLENGES.sql}) WHERE {_IN_SPAN}",
    ),
    Query(
        "problem_tree",
        _problem_tree,
        f"""SELECT id, title, problem, difficulty, solution, story AS story_problem
        FROM ({V.PROBLEMS.sql})""",
    ),
    Query(
        "results_tree",
        _results_tree,
        f"""WITH f AS ({V.RESULT_FILES.sql}), n AS (SELECT *, split_part(path, '/', -1) AS name FROM f)
        SELECT split_part(name, '-', 1) AS model, CASE WHEN id IS NULL THEN 'aoc' ELSE 'euler' END AS subset,
            CASE WHEN contains(name, '_converted') THEN 'leet' WHEN contains(name, '_stories') THEN 'story'
                ELSE 'original' END AS variant,
            CAST(regexp_extract(name, '@(.)', 1) AS INTEGER) AS k, row_no, year, day, part, id, status,
            concat('code, "of" ', row_no) AS code
        FROM n WHERE NOT starts_with(name, 'old-')""",
    ),
    Query(
        "document_tree",
        _document_tree,
        f"SELECT year, day, part, text FROM ({PART_TEXTS.sql}) WHERE {_IN_SPAN}",
    ),
]
