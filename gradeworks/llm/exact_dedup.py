"""Exact dedup against a history held in minimal perfect hash tables.

Two texts are equal if they are the same after each run of white space is made one blank; the
SHA-256 of that form is a text's digest. The history is an index of distinct digests in shards.
A shard is a minimal perfect hash: level by level, the digests that are alone at their place of
a bit table are settled there, the others go on to the next, smaller level; the rank of its bit
is a digest's slot. A slot holds the full digest, the locator of its winner (id and row) and the
number of its rows. A lookup goes to one slot and compares all the digest's bytes, so that a
digest that is not in the history is never taken for one that is.

A batch is looked up row by row: members add to their slots' winners and counts, nonmembers are
grouped among themselves, and both with the history make the next index. Rows carry their digest
and id only, never the text. Shards hold some SHARD_DIGESTS digests each, however many there are.
Rows of a shard are dealt to as many pieces of PIECE_ROWS as their number asks for, each with
the shard's table, so that a text that makes up a third of the corpus is spread over many
tasks; sums by digest combine in the tasks before they are shuffled.

The row of the smallest id stays of equal texts; among repeated rows of that id it is one of
them. A null id comes after all others, and a group of null ids only keeps one of its rows, with
a null ``keep_id``. A null text is an empty one. Every row of the input has its row in the
result. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import dealt, id_bucket, mixed, read_table
from gradeworks.session import new_table_path

SHARD_DIGESTS = 1 << 15
# Bits of a level for each digest that reaches it, and levels at most.
_SPACE = 2
_LEVELS = 200

# In the query, documents of one half (by a hash of the id) are the history of the other half.
_FOLDS, _HISTORY = 2, 0


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class PerfectHash:
    """A slot of its own for each of the digests it was built from, given as rows of four numbers."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        whole = np.concatenate([np.zeros(1, bool), *levels])
        self.ranks = np.cumsum(whole)
        self.starts = np.cumsum([0, *map(len, levels)])

    @staticmethod
    def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            made = np.full(len(digests), level + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for part in digests.T:
                made = mixed(made + part)
        return (made % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        levels, left = [], digests
        while len(left):
            if len(levels) == _LEVELS:
                raise ValueError("the digests are not distinct")
            places = cls._places(left, len(levels), _SPACE * len(left))
            alone = np.bincount(places, minlength=_SPACE * len(left)) == 1
            levels.append(alone)
            left = left[~alone[places]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1, or the slot of another one, if it is none of those built from."""
        found, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            places = self._places(digests[left], level, len(bits))
            here = bits[places]
            found[left[here]] = self.ranks[self.starts[level] + places[here]]
            left = left[~here]
        return found


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests as rows of four numbers."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(whole.to_pylist()), np.uint64).reshape(-1, 4)


def _shard(shards: int) -> Column:
    return (F.crc32("digest") % shards).cast("int").alias("shard")


def winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, n) of rows (digest, doc_id, row, n): the smallest id, nulls last."""
    first = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), first.alias("keep_row"), F.sum("n").alias("n"))


_INDEX = (
    "shard int, sizes array<int>, bits binary, digests binary, keep_id array<long>, keep_row array<long>, n array<long>"
)


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of ``groups`` (``winners``); written to the shared folder."""

    def built(table: pa.Table) -> pa.Table:
        digests = _numbers(table["digest"])
        table_of = PerfectHash.of(digests)
        order = np.empty(len(digests), np.int64)
        order[table_of.slots(digests)] = np.arange(len(digests))
        bits = np.concatenate(table_of.levels)
        row = {
            "shard": [table["shard"][0].as_py()],
            "sizes": [[len(level) for level in table_of.levels]],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [digests[order].tobytes()],
        }
        for name in ("keep_id", "keep_row", "n"):
            row[name] = [table[name].take(pa.array(order)).to_pylist()]
        types = [pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        return pa.table(row, pa.schema(list(zip(row, types, strict=True))))

    path = new_table_path(groups.sparkSession, "digest-index")
    groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(built, _INDEX).write.parquet(path)
    return groups.sparkSession.read.schema(_INDEX).parquet(path)


def _read(row: dict) -> tuple[PerfectHash, np.ndarray]:
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
    levels = np.split(bits, np.cumsum(row["sizes"])[:-1])
    return PerfectHash(levels), np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Rows (digest, doc_id, row) with their slot's winner and count, null where the digest is no member."""
    sharded = rows.select("digest", "doc_id", "row", _shard(shards))
    met, tables = dealt(sharded, index, "row")
    schema = "digest binary, doc_id long, row long, keep_id long, keep_row long, n long"

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("keep_id", "keep_row", "n")
        digests, found = _numbers(left["digest"]), None
        if len(right) and len(digests):
            table, held = _read({c: right[c][0].as_py() for c in ("sizes", "bits", "digests")})
            slots = table.slots(digests)
            member = (slots >= 0) & (held[slots] == digests).all(axis=1)
            at = pa.array(np.where(member, slots, 0), mask=~member)
            found = [right[name].combine_chunks().flatten().take(at) for name in names]
        found = found or [pa.nulls(len(digests), pa.int64()) for _ in names]
        columns = [left[c].combine_chunks() for c in ("digest", "doc_id", "row")] + found
        return pa.table(columns, names=["digest", "doc_id", "row", *names])

    keys = ("shard", "piece")
    return met.groupBy(*keys).cogroup(tables.groupBy(*keys)).applyInArrow(matched, schema)


def extended(history: DataFrame, index: DataFrame, shards: int, batch: DataFrame) -> DataFrame:
    """The winners of the history and of a batch of rows (digest, doc_id, row) that is looked up in its index."""
    path = new_table_path(batch.sparkSession, "batch-look-up")
    look_up(batch, index, shards).write.parquet(path)
    found = batch.sparkSession.read.parquet(path)
    # Members and nonmembers alike leave one row a digest in each task before anything moves.
    new = found.where(F.col("keep_row").isNull()).withColumn("n", F.lit(1).cast("long"))
    repeats = found.where(F.col("keep_row").isNotNull()).withColumn("n", F.lit(1).cast("long"))
    columns = ["digest", "doc_id", "row", "n"]
    known = history.select("digest", F.col("keep_id").alias("doc_id"), F.col("keep_row").alias("row"), "n")
    return winners(known.union(repeats.select(*columns))).union(winners(new.select(*columns)))


def _shards(rows: int) -> int:
    return max(1, -(-rows // SHARD_DIGESTS))


def digest_table(docs: DataFrame, **more: Column) -> DataFrame:
    """(digest, doc_id, row) of every document, and ``more`` columns; written, so that row numbers stay."""
    path = new_table_path(docs.sparkSession, "digests")
    digest = F.unhex(F.sha2(normalised(docs["text"]), 256)).alias("digest")
    row = F.monotonically_increasing_id().alias("row")
    doc_id = docs["doc_id"].cast("long").alias("doc_id")
    docs.select(digest, doc_id, row, *[c.alias(n) for n, c in more.items()]).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def decide(rows: DataFrame, history: Column) -> DataFrame:
    """Winner and group size of every row of a ``digest_table``, the rows of ``history`` indexed first."""
    spark, shards = rows.sparkSession, _shards(rows.count())
    one = F.lit(1).cast("long").alias("n")
    path = new_table_path(spark, "winners")
    winners(rows.where(history).select("*", one)).write.parquet(path)
    known = spark.read.parquet(path)
    merged = extended(known, build_index(known, shards), shards, rows.where(~history))
    found = look_up(rows, build_index(merged, shards), shards)
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return found.select("doc_id", "row", "digest", "keep_id", F.col("n").alias("group_size"), kept)


def _is_history(doc_id: str = "doc_id") -> Column:
    return id_bucket(F.col(doc_id), _FOLDS) == _HISTORY


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, whole and with all their columns."""
    rows = digest_table(docs, doc=F.struct(*[docs[c] for c in docs.columns]))
    kept = decide(rows.select("digest", "doc_id", "row"), _is_history()).where("kept").select("row")
    return rows.join(kept, "row").select("doc.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner and size of each document's group of equal texts."""
    found = decide(digest_table(read_table(spark, sf_dir, "documents")), _is_history())
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
