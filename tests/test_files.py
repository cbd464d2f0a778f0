"""Readers and writers on small files in the corpus and results formats."""

import csv
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from gradeworks import session
from gradeworks.plans.leaderboard import leaderboards
from gradeworks.sources import corpus as C
from gradeworks.sources import results as S
from gradeworks.sources import writers as W


def part(description, answer, converted=None):
    record = {"description": description, "answer": answer}
    return record if converted is None else {**record, "converted_description": converted}


@pytest.fixture
def tree(tmp_path):
    """Challenge files by year and day: optional fields, a bad file, a stray file."""
    def put(year, day, text):
        folder = tmp_path / "corpus" / str(year)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"day_{day}.json").write_text(text)

    put(2015, 1, json.dumps({"year": 2015, "day": 1, "part1": part("", "0101", "c1"),
                             "part2": part("b", "x,y"), "input": "1\n2"}, indent=2))
    put(2015, 25, json.dumps({"year": 2015, "day": 25, "part1": part("a", "##\n#."),
                              "part2": part("b", "", "c2")}))
    put(2016, 3, json.dumps({"year": "2016", "day": "3", "part1": part("a", "11266889531"), "part2": part("b", "é")}))
    put(2016, 4, '{"year": 2016, "day": 4, "part1": ')
    (tmp_path / "corpus" / "2015" / "notes.json").write_text("{}")
    return str(tmp_path / "corpus")


def test_challenge_tree(spark, tree):
    rows = {(r.year, r.day): r for r in C.read_challenges(spark, tree).collect()}
    assert set(rows) == {(2015, 1), (2015, 25), (2016, 3)}
    first = rows[(2015, 1)]
    assert (first.part1, first.part1_converted, first.part1_solution) == ("", "c1", "0101")
    assert first.part2_converted is None and first.input == "1\n2"
    assert rows[(2015, 25)].part1_solution == "##\n#." and rows[(2015, 25)].part2_solution == ""
    assert rows[(2016, 3)].input is None and rows[(2016, 3)].part1_solution == "11266889531"


def test_malformed_files(spark, tree):
    folder = pathlib.Path(tree) / "2016"
    (folder / "day_5.json").write_text(" \n")
    records = C.read_nested_challenges(spark, tree)
    bad = sorted(C.quarantined(records).collect())
    assert [(r.year, r.day) for r in bad] == [(2016, 4), (2016, 5)]
    assert '"part1": ' in bad[0][C.CORRUPT]
    assert C.quarantined(records).select(C.CORRUPT).count() == 2
    assert C.read_challenges(spark, tree).count() == 3
    with pytest.raises(Exception):
        C.read_challenges(spark, tree, strict=True).collect()


def test_problem_arrays(spark, tmp_path):
    one = {"id": 1, "title": "t", "problem": "p", "difficulty": 5, "solution": "0", "story": "s"}
    (tmp_path / "a.json").write_text(json.dumps([one, {**one, "id": 2, "solution": "1.5"}]))
    (tmp_path / "b.json").write_text(json.dumps([{**one, "id": 3}]))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.txt").write_text(json.dumps([{**one, "id": 9}]))
    rows = sorted(C.read_problems(spark, str(tmp_path)).collect())
    assert [(r.id, r.solution, r.difficulty) for r in rows] == [
        (1, "0", "5"), (2, "1.5", "5"), (3, "0", "5")]
    assert rows[0].story_problem == "s"


def test_subset_dispatch(spark, tree, tmp_path):
    absent = str(tmp_path / "absent")
    assert C.read_subset(spark, "aoc", absent, lite_root=tree).count() == 3
    assert C.read_subset(spark, "aoc", tree, lite_root=absent).count() == 3
    with pytest.raises(ValueError):
        C.read_subset(spark, "other", tree)


def test_raw_documents(spark, tmp_path):
    folder = tmp_path / "puzzles" / "2015"
    folder.mkdir(parents=True)
    (folder / "day_3_part2.md").write_text("x\n\ny")
    (folder / "readme.md").write_text("z")
    rows = {r.text: (r.year, r.day, r.part) for r in
            C.read_documents(spark, str(tmp_path / "puzzles")).collect()}
    assert rows == {"x\n\ny": (2015, 3, 2), "z": (None, None, None)}


CODE = 'print("a, b")\nfor x in "q":\n    pass\n'
HEADER = ["", "year", "day", "part", "status", "output", "expected_output", "error", "code",
          "kpass"]


def put_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([header, *rows])


@pytest.fixture
def results_tree(tmp_path):
    root = tmp_path / "results"
    rows = [[0, 2015, 1, 1, "no_error", " 12 ", "12", "", CODE, "0.0"],
            [1, 2015, 1, 2, "part1_failed", "", "007", "", "", ""]]
    put_csv(root / "folder" / "m_1-aoc-pass@3.csv", HEADER, rows)
    put_csv(root / "folder" / "m_1-aoc_converted-pass@1.csv", HEADER, rows[:1])
    put_csv(root / "folder" / "a-b-aoc-pass@3.csv", HEADER, rows)
    (root / "folder" / "m_1-aoc-pass@1.txt").write_text("no")
    return str(root)


def test_results_csv(spark, results_tree):
    path = f"{results_tree}/folder/m_1-aoc-pass@3.csv"
    first, second = sorted(S.read_results(spark, path, "aoc").collect())
    assert (first.row_no, first.code, first.output, first.kpass) == (0, CODE, " 12 ", 0)
    assert (second.expected_output, second.output, second.kpass) == ("007", None, None)
    with pytest.raises(ValueError):
        S.read_results(spark, path, "other")


def test_math_results_csv(spark, tmp_path):
    put_csv(tmp_path / "m-euler-pass@1.csv",
            ["", "id", "status", "output", "expected_output", "error", "code", "difficulty"],
            [[0, 7, "no_error", "1", "1", "", CODE, "15"]])
    row = S.scan_results(spark, str(tmp_path), "euler").first()
    assert (row.id, row.difficulty, row.model, row.variant, row.k) == (7, "15", "m", "original", 1)


def test_scan_takes_the_run_from_file_names(spark, results_tree):
    rows = S.scan_results(spark, results_tree, "aoc")
    runs = {(r.model, r.variant, r.k) for r in rows.collect()}
    assert runs == {("m_1", "original", 3), ("m_1", "leet", 1)}
    assert rows.count() == 3


def test_leaderboard_from_a_results_folder(spark, results_tree):
    put_csv(pathlib.Path(results_tree) / "other" / "m_1-euler_story-pass@3.csv",
            ["", "id", "status", "output", "expected_output", "error", "code", "difficulty"],
            [[0, 7, "no_error", "1", "1", "", CODE, "15"],
             [1, 7, "wrong_output", "1", "1", "", CODE, "15"],
             [2, 8, "runtime_error", "", "1", "x\ny", CODE, "20"]])
    rows = S.scan_all_results(spark, results_tree)
    assert rows.count() == 6
    board = leaderboards(rows)["models"].collect()
    assert [(r.model, r.aoc_original_k3, r.aoc_leet_k1, r.euler_story_k3) for r in board] == [
        ("m-1", 50.0, 100.0, 50.0)]
    plan = S.scan_results(spark, results_tree, "euler")._jdf.queryExecution()
    assert "file_path" in plan.executedPlan().toString()


def test_result_names(frame):
    names = ["m-aoc-pass@3.csv", "/x/m-euler_stories-pass@1.csv", "m-aoc_a_b-pass@1.csv",
             "a-b-aoc-pass@1.csv", "m-aoc-pass3.csv", "m-aoc-pass@x.csv", "m-aoc-pass@1.txt",
             "m.5-euler_x-pass@10.csv", "m-other-pass@1.csv"]
    rows = frame([(n,) for n in names], "path string")
    found = {r.path: (r.model, r.subset, r.variant, r.k)
             for r in S.parse_result_name(rows).collect()}
    absent = (None, None, None, None)
    assert [found[n] for n in names] == [
        ("m", "aoc", "original", 3), ("m", "euler", "story", 1), absent, absent, absent,
        absent, absent, ("m.5", "euler", "story", 10), absent]


def test_report_files(frame):
    rows = frame([(p,) for p in ["r/gpt-4/gpt3.5-aoc-pass@3.csv", "r/gpt-4/gpt_4-aoc-pass@3.csv",
                                 "r/a-b/a_b-euler_stories-pass@3.csv", "r/a-b/a_b-aoc-pass@1.csv"]],
                 "path string")
    found = {(r.model, r.subset) for r in S.report_files(rows).collect()}
    assert found == {("gpt-4", "aoc"), ("a-b", "euler_stories")}


def test_export_and_result_round_trips(spark, frame, tmp_path):
    rows = frame([(1, 2015, 1, 1, "no_error", " a\t", "01", None, CODE, 0.0)],
                 "row_no long, year int, day int, part int, status string, output string, "
                 "expected_output string, error string, code string, kpass double")
    W.export_results(rows, str(tmp_path / "csv"))
    row = S.read_results(spark, str(tmp_path / "csv"), "aoc").first()
    assert (row.row_no, row.output, row.code, row.error) == (1, " a\t", CODE, None)


def test_snapshot_replaces_only_its_years(spark, frame, tmp_path):
    path = str(tmp_path / "snapshot")
    W.write_snapshot(frame([(2015, "old"), (2016, "old")], "year int, status string"), path)
    W.write_snapshot(frame([(2016, "new")], "year int, status string"), path)
    found = {(r.year, r.status) for r in spark.read.parquet(path).collect()}
    assert found == {(2015, "old"), (2016, "new")}


def test_shared_folder_comes_from_the_session(spark):
    folder = session.shared_folder(spark)
    assert folder == spark.conf.get(session.FOLDER_SETTING)
    first, second = [session.new_table_path(spark, "t") for _ in range(2)]
    assert first.startswith(folder) and first != second


def test_listing_stays_on_the_driver(spark, tree):
    """The keys agree with the path for every file of the tree."""
    rows = C.read_nested_challenges(spark, tree).where(F.col(C.CORRUPT).isNull())
    assert rows.where("year = 2016").first().day == 3
