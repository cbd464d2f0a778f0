"""Helpers the operators share: reading texts in bounded slices, hashing words, buckets of ids."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are handled in slices of about so many bytes, so that the arrays built from them stay small.
SLICE_BYTES = 2 << 20
# Rows of a batch that goes to Python.
TEXT_ROWS = 1000
# A worker forgets its remembered words beyond so many; they are then worked out again.
MEMO_ENTRIES = 450_000

# UTF-8 bytes that end a word: space and the five control characters from tab to return.
SPACES = b" \t\n\x0b\x0c\r"


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id written as text, modulo ``buckets``; a null id is in bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(buckets), F.lit(0))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of about SLICE_BYTES with their texts as bytes (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        start = 0
        while start < len(column):
            stop = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), len(column))
            texts = column.slice(start, stop - start).cast(pa.large_binary()).fill_null(b"")
            yield batch.slice(start, stop - start), texts.to_pylist()
            start = stop


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches' rows in tables of ``rows`` rows, however short the batches are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, rows)
            held = whole.slice(rows).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


class Memo(dict):
    """Remembers a value for each key; ``clear_if_full`` bounds it between slices."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def clear_if_full(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.clear()


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """All items in a row, and where each list starts (with the end of the last)."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return list(itertools.chain.from_iterable(lists)), ends


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of the texts, which of them stands at each place, and where each text starts.

    Words are what ASCII white space parts, as ``bytes.split`` has it.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes() if len(words) else b""
    found = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    # White space at the ends of a text leaves empty words.
    stays = codes != found.index(b"") if b"" in found else np.ones(len(codes), bool)
    starts = np.concatenate([[0], np.cumsum(stays)])[lists.offsets.to_numpy()]
    return found, codes[stays], starts


def rolling_hash(symbols: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of every ``width`` consecutive symbols, by start; mixed so that all bits matter."""
    count = len(symbols) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    result = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            result = result * np.uint64(factor) + symbols[i : i + count]
    return mixed(result)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32))


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame cut from its lineage by files in the folder all executors share."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        from gradeworks.session import shared_folder

        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


# Rows of a piece of a shard, and so many sizes of shards that are sent to every task.
PIECE_ROWS = 1 << 17
SENT_SHARDS = 100_000


def dealt(rows: DataFrame, tables: DataFrame, spread: str) -> tuple[DataFrame, DataFrame]:
    """Rows and the tables of their shards (both with ``shard``) with the piece of the shard they meet in.

    The rows of a shard are counted first and dealt by a hash of ``spread`` to as many pieces of
    PIECE_ROWS as they ask for; the shard's table is repeated for each. A hot shard is so spread over
    many tasks.
    """
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))
    large = sizes.where(F.col("pieces") > 1)
    count = large.limit(SENT_SHARDS + 1).count()
    names = rows.columns, tables.columns
    pieces, piece = F.lit(1), F.lit(0)
    if count:
        sent = F.broadcast(large) if count <= SENT_SHARDS else large
        rows, tables = rows.join(sent, "shard", "left"), tables.join(sent, "shard", "left")
        pieces = F.coalesce("pieces", F.lit(1))
        piece = F.pmod(F.xxhash64(spread), pieces).cast("int")
    every = F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")
    return rows.select(*names[0], piece.alias("piece")), tables.select(*names[1], every)


def short_batches(spark: SparkSession) -> None:
    """Has the session send TEXT_ROWS rows at a time to Python, as rows with texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; reading documents sets ``short_batches``."""
    if name == "documents":
        short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
