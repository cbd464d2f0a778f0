"""Trees of many small files: written in one pass, and read in tasks of bytes instead of files."""

from collections.abc import Iterator
from contextlib import contextmanager
from fnmatch import fnmatchcase
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A task of its own is worth so many bytes, while there are idle cores.
TASK_BYTES = 1 << 20
# A task reads so many bytes of files at most, but for one larger file.
MOST_TASK_BYTES = 16 << 20
# Lines that go to Python at once.
LINE_ROWS = 1000
# Rows of a listing that leave a task at once, and bytes of files that do.
LISTED_ROWS = 10_000
READ_BYTES = 4 << 20
# A tree with more entries at its top is listed by tasks, as Spark's own listing does; small ones are not worth a job.
_MOST_LISTED = "spark.sql.sources.parallelPartitionDiscovery.threshold"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_tree(lines: DataFrame, root: str) -> int:
    """Writes rows (path, place, line) to the files ``path`` below ``root``; returns how many there are.

    The lines of a file are written by ``place``, one after the other, so that a task holds one batch of
    them. ``root`` is a URI that executors and pyarrow can open, or a path on a shared disk. A task that
    runs again writes the same files again.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        path, out, count = None, None, 0
        for batch in batches:
            for own, line in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if own != path:
                    if out:
                        out.close()
                    path, count = own, count + 1
                    files.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(f"{base}/{path}")
                out.write(line.as_buffer())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([count])], ["files"])

    rows = lines.select("path", "place", "line")
    sorted_lines = rows.repartition("path").sortWithinPartitions("path", "place")
    with _short_batches(lines.sparkSession):
        return sorted_lines.mapInArrow(written, "files long").agg(F.sum("files")).first()[0] or 0


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send LINE_ROWS rows at a time to Python; the session's own setting returns after."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(LINE_ROWS, int(before)) if int(before) > 0 else LINE_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def one_line_files(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """Rows for ``write_tree`` that put each text in a file of its own."""
    return rows.select(path.alias("path"), F.lit(0).alias("place"), text.alias("line"))


def tree_bytes(spark: SparkSession, root: str) -> int:
    """Bytes of all files below a folder, or below those a pattern names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(place) or []
    return sum(files.getContentSummary(status.getPath()).getLength() for status in found)


def year_folders(spark: SparkSession, root: str, years: tuple[int, int]) -> list[str]:
    """The entries of a tree that can hold files of the years, so that no others are listed.

    A folder named by a plain number is that of a year; entries with any other name are kept. Without
    any entry the root itself is given.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = ",".join(str(year) for year in range(years[0], years[1] + 1))
    names = [f"{{{wanted}}}", "*[!0-9]*", "0*"]
    found = [s.getPath().toString() for n in names for s in files.globStatus(hadoop.Path(place, n)) or []]
    # Names that begin like this are hidden to Spark's listing as well.
    shown = {path for path in found if path.rsplit("/", 1)[1][0] not in "._"}
    return sorted(shown) or [root]


def folder_uri(spark: SparkSession, root: str) -> str | None:
    """The folder as a URI that pyarrow opens; None for patterns and for stores that only Spark reads."""
    if any(c in root for c in "*?[{"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    uri = uri.replace("file:/", "file:///", 1) if not uri.startswith("file://") else uri
    try:
        files, base = fs.FileSystem.from_uri(uri)
        return uri if files.get_file_info(base).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def listed(spark: SparkSession, uri: str, names: str) -> DataFrame | None:
    """(path, size) of a tree's files with such names, or None where Spark's listing serves.

    One task lists the top of the tree, many the folders there, so that no listing comes to the driver.
    """
    files, base = fs.FileSystem.from_uri(uri)
    count = len(files.get_file_info(fs.FileSelector(base)))
    if count <= int(spark.conf.get(_MOST_LISTED)):
        return None

    def rows(infos) -> Iterator[pa.RecordBatch]:
        for some in batched(infos, LISTED_ROWS):
            columns = [pa.array([i.path for i in some]), pa.array([i.size for i in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "size"])

    def hidden(name: str) -> bool:
        """Whether Spark's listing leaves the name out."""
        kept = name.startswith(("_metadata", "_common_metadata")) or (name.startswith("_") and "=" in name)
        return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and not kept)

    def shown(infos) -> Iterator:
        """What Spark's reader reads, which leaves empty files out; a folder has no size."""
        for info in infos:
            if not any(map(hidden, info.path[len(base) + 1 :].split("/"))):
                if not info.is_file or (info.size and fnmatchcase(info.base_name, names)):
                    yield info

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(uri)
        for _ in batches:
            yield from rows(shown(files.get_file_info(fs.FileSelector(base))))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(uri)

        def found() -> Iterator:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    info = files.get_file_info(path)
                    if info.is_file:
                        yield info
                    else:
                        inside = files.get_file_info(fs.FileSelector(path, recursive=True))
                        yield from (i for i in shown(inside) if i.is_file)

        yield from rows(found())

    entries = spark.range(0, 1, 1, 1).mapInArrow(top, "path string, size long")
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // LISTED_ROWS))
    return entries.repartition(tasks).mapInArrow(below, "path string, size long")


def read_listed(files: DataFrame, uri: str) -> DataFrame:
    """(path, value) of listed files, as whole texts; they are dealt by their paths to tasks of some bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        paths, texts, size = [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "value"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as file:
                    text = file.read()
                paths.append(path)
                texts.append(text)
                size += len(text)
                if size >= READ_BYTES:
                    yield rows()
                    paths, texts, size = [], [], 0
        yield rows()

    size = files.agg(F.sum("size")).first()[0] or 0
    dealt = files.select("path").repartition(task_count(files.sparkSession, size), "path")
    # Bytes become a text as they are, as Spark's reader has it.
    return dealt.mapInArrow(read, "path string, value binary").withColumn("value", F.col("value").cast("string"))


def packed(rows: DataFrame, *roots: str) -> DataFrame:
    """Rows read from trees, in as many tasks as their bytes ask for.

    Spark counts every file as some megabytes more than it has, which makes a task of a few dozen small
    files. Here a task takes files up to MOST_TASK_BYTES, or to the size of a usual split if that is less.
    """
    spark = rows.sparkSession
    return rows.coalesce(task_count(spark, sum(tree_bytes(spark, root) for root in roots)))


def task_count(spark: SparkSession, size: int) -> int:
    """How many tasks read so many bytes of files."""
    # Read as a number of bytes whatever unit the session gives it in.
    split = min(MOST_TASK_BYTES, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    idle = min(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return max(1, -(-size // split), idle)
