"""Trees of small files: what is written, how many tasks read them, and which files are read."""

from pyspark.sql import functions as F

from gradeworks.operators.tasks import TaskSpan
from gradeworks.sources import corpus as C
from gradeworks.sources import trees as T


def files_read(rows):
    rows.collect()
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()))


def challenge_tree(frame, root, years=4, days=25):
    rows = [(2015 + y, 1 + d, f'{{"year": {2015 + y}, "day": {1 + d}, "input": "x{y}"}}') for y in range(years) for d in range(days)]
    table = frame(rows, "year int, day int, text string")
    path = F.concat(F.col("year").cast("string"), F.lit("/day_"), F.col("day").cast("string"), F.lit(".json"))
    return T.write_tree(T.one_line_files(table, path, F.col("text")), root)


def test_lines_are_written_in_their_order(spark, frame, tmp_path):
    rows = [(f"a/{i % 3}.txt", i, f"{i} é\n") for i in range(300)]
    assert T.write_tree(frame(rows, "path string, place int, line string").repartition(7), str(tmp_path)) == 3
    for i in range(3):
        text = (tmp_path / "a" / f"{i}.txt").read_text(encoding="utf-8")
        assert text == "".join(f"{n} é\n" for n in range(i, 300, 3))
    assert T.write_tree(frame([], "path string, place int, line string"), str(tmp_path)) == 0


def test_small_files_share_tasks(spark, frame, tmp_path):
    assert challenge_tree(frame, str(tmp_path)) == 100
    rows = C.read_challenges(spark, str(tmp_path))
    assert rows.count() == 100
    assert rows.rdd.getNumPartitions() == 1
    assert T.tree_bytes(spark, str(tmp_path)) == sum(p.stat().st_size for p in tmp_path.rglob("*.json"))


def test_files_outside_the_span_are_not_read(spark, frame, tmp_path):
    challenge_tree(frame, str(tmp_path))
    rows = C.read_nested_challenges(spark, str(tmp_path), span=TaskSpan((2016, 2017), (1, 5)))
    assert files_read(rows) == 10
    assert {(r.year, r.day) for r in rows.collect()} == {(y, d) for y in (2016, 2017) for d in range(1, 6)}


def test_folders_of_other_years_are_not_listed(spark, frame, tmp_path):
    challenge_tree(frame, str(tmp_path), years=6)
    for odd in ("more/2016", "02017", "_hidden/2016"):
        (tmp_path / odd).mkdir(parents=True)
        (tmp_path / odd / "day_30.json").write_text('{"input": "odd"}')
    (tmp_path / "20160").mkdir()
    rows = C.read_nested_challenges(spark, str(tmp_path), span=TaskSpan((2016, 2017), (1, 30)))
    listed = {p.rsplit("/", 1)[0].removeprefix(f"file://{tmp_path}/") for p in rows.inputFiles()}
    assert listed == {"2016", "2017", "more/2016", "02017"}
    assert sorted((r.year, r.day) for r in rows.collect() if r.day == 30) == [(2016, 30), (2017, 30)]
    assert rows.count() == 52
    assert C.read_nested_challenges(spark, str(tmp_path), span=TaskSpan((1999, 2001), (1, 30))).count() == 0


def test_a_task_reads_a_bounded_part_of_a_tree(spark, frame, tmp_path, monkeypatch):
    challenge_tree(frame, str(tmp_path))
    size = T.tree_bytes(spark, str(tmp_path))
    monkeypatch.setattr(T, "MOST_TASK_BYTES", size // 9)
    rows = C.read_challenges(spark, str(tmp_path))
    assert rows.count() == 100
    # As many tasks as Spark's own splits allow.
    assert rows.rdd.getNumPartitions() == min(10, spark.read.text(f"{tmp_path}/*", wholetext=True).rdd.getNumPartitions())


def test_long_lines_go_to_python_some_at_a_time(spark, frame, tmp_path, monkeypatch):
    sizes, before = [], spark.conf.get(T._BATCH_ROWS)
    run = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda *a: sizes.append(spark.conf.get(T._BATCH_ROWS)) or run(*a))
    rows = [(f"{i}.txt", 0, "x" * 100) for i in range(20)]
    assert T.write_tree(frame(rows, "path string, place int, line string"), str(tmp_path)) == 20
    assert sizes == [str(T.LINE_ROWS)] and spark.conf.get(T._BATCH_ROWS) == before


def test_a_tree_of_many_years_is_listed_and_read_by_tasks(spark, frame, tmp_path, monkeypatch):
    """The same rows as by Spark's reader, with no listing of the files in the driver."""
    root = tmp_path / "tree"
    challenge_tree(frame, f"file://{root}")
    odd = {"more/2016/day_30.json": b"{}", "day_7.json": b'{"input": "top"}', "2017/day_x.json": b'{"input": "x"}', "2018/day_31.json": b"",
           "2018/notes.json": b"{}", "2018/day_32.json": b'{"input": "\xff\xc3"}', "_old/2015/day_1.json": b"{}", "2016/.day_1.json": b"{}",
           "2016/_day_2.json": b"{}", "_y=1/2019/day_2.json": b"{}", "2017/day_9.json._COPYING_": b"{}", "2015/day_33.json": b"\xef\xbb\xbf{}"}
    for name, text in odd.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    (root / "empty").mkdir()
    wanted = C.read_nested_challenges(spark, str(root))
    assert len(wanted.inputFiles()) > 100
    monkeypatch.setattr(T, "READ_BYTES", 200)
    monkeypatch.setattr(T, "LISTED_ROWS", 7)
    before = spark.conf.get(T._MOST_LISTED)
    spark.conf.set(T._MOST_LISTED, "3")
    try:
        found = C.read_nested_challenges(spark, str(root))
        monkeypatch.setattr(T, "MOST_TASK_BYTES", T.tree_bytes(spark, str(root)) // 9)
        assert 9 <= C.read_challenges(spark, str(root)).rdd.getNumPartitions() <= 10
        assert C.read_challenges(spark, f"{root}/201?").inputFiles()
    finally:
        spark.conf.set(T._MOST_LISTED, before)
    assert found.inputFiles() == []
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
