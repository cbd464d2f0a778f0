"""Token ids in plane-shuffled binary files.

A file holds blocks of BLOCK_IDS ids. A block is transposed into byte planes (all first bytes
of the ids, all second bytes, and so on) or bit planes, and each plane is compressed with
zstandard on its own; the high planes of small ids shrink to almost nothing. After the blocks
comes the chunk index: place, length and plane sizes of each block, then id and end of each
document, compressed as well, and last its size and a mark. So one block, or one document,
can be read without the rest.

Documents are dealt out in ranges of their ids and every task writes one file under a name of
its own attempt, then renames it; a task that runs again writes the same file again. A table
of the files in the same folder tells how many ids come before each.

Null and empty texts consist of the end id alone; texts of any length are written whole. Documents
with a null id come first; repeated ids are ordered by text, and repeated rows, whose ids are the
same, may lie in several files. An empty table gives no files and no rows. Other columns are not
read.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import distinct_words, read_table, slices
from gradeworks.llm.vocabulary import LibraryChunks, PieceTable
from gradeworks.session import new_table_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BLOCK_IDS = 1 << 16
_LEVEL = 3
_MARK = b"IDPLANE1"
_OUT_IDS = 1 << 20


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids: one for each byte, or each bit, that an id has."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [plane.tobytes() for plane in rows.T]
    return [np.packbits(plane).tobytes() for plane in np.unpackbits(rows, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The ids of a block from its planes."""
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == "bit":
        bits = np.stack([np.unpackbits(r, count=count) for r in rows], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    return np.stack(rows, axis=1).copy().view("<u4").ravel()


class PlaneWriter:
    """Writes documents' ids block by block, holding no more than one block and the index."""

    def __init__(self, out, kind: str = "byte") -> None:
        self.out, self.kind, self.place = out, kind, 0
        self.press = zstandard.ZstdCompressor(level=_LEVEL)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.blocks: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents whose ids stand in a row and end at ``ends``."""
        self.doc_ids += doc_ids
        self.ends += (ends + self.total).tolist()
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            row = np.concatenate(self.waiting)
            whole = len(row) // BLOCK_IDS * BLOCK_IDS
            for start in range(0, whole, BLOCK_IDS):
                self._block(row[start : start + BLOCK_IDS])
            self.waiting, self.held = [row[whole:]], len(row) - whole

    def _block(self, ids: np.ndarray) -> None:
        pressed = [self.press.compress(plane) for plane in to_planes(ids, self.kind)]
        self.blocks.append([self.place, len(ids), *map(len, pressed)])
        self._write(b"".join(pressed))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index = {"kind": self.kind, "blocks": self.blocks, "doc_ids": self.doc_ids, "ends": self.ends}
        pressed = self.press.compress(json.dumps(index).encode())
        self._write(pressed + struct.pack("<Q", len(pressed)) + _MARK)


class PlaneReader:
    """Reads single blocks and documents of a file by its chunk index."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != _MARK:
            raise ValueError("not a file of id planes")
        length = struct.unpack("<Q", tail[:8])[0]
        index = json.loads(zstandard.decompress(self._read(size - 16 - length, length)))
        self.kind, self.blocks = index["kind"], index["blocks"]
        self.doc_ids, self.ends = index["doc_ids"], np.array([0, *index["ends"]], np.int64)
        self.firsts = np.cumsum([0, *(b[1] for b in self.blocks)])

    def _read(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def block(self, number: int) -> np.ndarray:
        place, count, *sizes = self.blocks[number]
        data, planes = self._read(place, sum(sizes)), []
        for size in sizes:
            planes.append(zstandard.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, count, self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only the blocks that hold them are read."""
        if start == stop:
            return np.empty(0, np.uint32)
        first = int(np.searchsorted(self.firsts, start, side="right")) - 1
        last = int(np.searchsorted(self.firsts, stop, side="left"))
        row = np.concatenate([self.block(i) for i in range(first, last)])
        return row[start - self.firsts[first] : stop - self.firsts[first]]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, next document, their ids in a row) in parts of about _OUT_IDS ids."""
        at = 0
        while at < len(self.doc_ids):
            stop = int(np.searchsorted(self.ends, self.ends[at] + _OUT_IDS, side="right")) - 1
            stop = min(max(stop, at + 1), len(self.doc_ids))
            yield at, stop, self.ids(int(self.ends[at]), int(self.ends[stop]))
            at = stop


@functools.cache
def _library_pieces(path: str) -> PieceTable:
    """Ids of stretches without ASCII white space, which this vocabulary encodes one by one."""
    return PieceTable(LibraryChunks(path).encode)


def _with_ends(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, ends, END_ID).astype(np.uint32), ends + np.arange(1, len(ends) + 1)


def _write_file(folder: str, parts: Iterable[tuple[list, np.ndarray, np.ndarray]], kind: str) -> tuple | None:
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    context, writer = TaskContext.get(), None
    name = f"ids-{context.partitionId():06d}.planes"
    draft = f"{root}/.{name}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
    for doc_ids, ids, ends in parts:
        if writer is None:
            files.create_dir(root, recursive=True)
            out = files.open_output_stream(draft)
            writer = PlaneWriter(out, kind)
        writer.add(doc_ids, ids, ends)
    if writer is None:
        return None
    writer.close()
    out.close()
    files.move(draft, f"{root}/{name}")
    return context.partitionId(), name, len(writer.doc_ids), writer.total


def write_tokens(docs: DataFrame, folder: str, path: str = TOKENIZER, kind: str = "byte") -> None:
    """Encodes the documents and writes them to files in ``folder`` in the order of their ids.

    ``folder`` is a URI that executors and pyarrow can open, or a path on a shared disk.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _library_pieces(path)

        def parts():
            for batch, _ in slices(batches):
                chunks, order, starts = distinct_words(batch.column(1))
                ids, counts = table.look_up(chunks, order)
                sums = np.concatenate([[0], np.cumsum(counts)])[starts[1:]]
                yield batch.column(0).to_pylist(), *_with_ends(ids, sums)

        made = _write_file(folder, parts(), kind)
        if made:
            columns = [pa.array([x]) for x in made]
            yield pa.RecordBatch.from_arrays(columns, ["part", "name", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Repeated rows are told apart by their place, so that no range has to take all of them.
    tie, place = F.xxhash64("text"), F.monotonically_increasing_id()
    placed = rows.withColumn("place", place)
    ordered = placed.repartitionByRange(F.col("doc_id"), tie, F.col("place"))
    ordered = ordered.sortWithinPartitions("doc_id", tie, "text", "place").drop("place")
    files = ordered.mapInArrow(written, "part long, name string, n_docs long, n_ids long")
    files.write.parquet(f"{folder}/files")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document from the files in ``folder``.

    ``start`` counts the ids of all documents before; ids are little-endian unsigned 32-bit.
    """
    files = spark.read.parquet(f"{folder}/files")
    # One row for each file, which one task of the writing job made.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['name']}") as file:
                    reader = PlaneReader(file)
                    for at, stop, ids in reader.documents():
                        ends = reader.ends[at : stop + 1]
                        data, inside = ids.astype("<u4"), ends - ends[0]
                        parts = [data[a:b].tobytes() for a, b in zip(inside, inside[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[at:stop], pa.int64()),
                                pa.array(ends[:-1] + row["first"]),
                                pa.array(parts, pa.binary()),
                            ],
                            ["doc_id", "start", "ids"],
                        )

    tasks = max(1, files.count())
    return placed.repartition(tasks).mapInArrow(read, "doc_id long, start long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as plane-shuffled ids, and what the files give back."""
    folder = new_table_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
