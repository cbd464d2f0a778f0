"""Line dedup by exact reference counts and sharded cuckoo filters.

The reference-count table holds, for every line key, the number of documents it is found in.
It is exact (keys are 128-bit digests) and additive, so documents can be added and taken out
again. Keys found in at least ``least`` documents are also kept in cuckoo filters, one for
each shard of the keys. A filter drops a key again when its count falls below ``least``.

Lines are first held against the filters, which let almost nothing but true finds through;
the finds are then joined with the exact table, so a false positive of a filter never costs
a line.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.
Null and empty texts are one empty line; texts of any length are taken whole. Empty keys are never
dropped. Every row counts as a document, repeated rows and rows with a null id as well, and has its
row in the result, ties included. An empty table has no rows. Other columns are carried along in
``doc``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import SPACES, dealt, mixed, read_table, slices
from gradeworks.session import new_table_path

KEYS_PER_SHARD = 250_000
# Filters of up to so many bytes in all are sent to every task; beyond that the lines are dealt
# to the shards of their keys and meet the filters there.
FILTER_BYTES = 64 << 20

_SLOTS = 4
_KICKS = 500


class CuckooFilter:
    """Set of 64-bit keys as 16-bit fingerprints, four to a bucket, with deletion."""

    def __init__(self, keys: int = 0, table: bytes | None = None) -> None:
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (_SLOTS * 0.5)))))
            self.table = np.zeros((buckets, _SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, _SLOTS).copy()
        self.mask = np.uint64(len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mixed(keys) & self.mask
        return prints, first, first ^ (mixed(prints.astype(np.uint64)) & self.mask)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds the keys; False if one found no room, and the filter must be built anew."""
        for mark, *places in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            if not (self._put(places[0], mark) or self._put(places[1], mark) or self._kick(places[1], mark)):
                return False
        return True

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return bool(len(free))

    def _kick(self, bucket: int, mark: int) -> bool:
        for turn in range(_KICKS):
            slot = turn % _SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= int(mixed(np.array([mark], np.uint64))[0] & self.mask)
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        for mark, *places in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in places:
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        marks = prints[:, None]
        return (self.table[first] == marks).any(axis=1) | (self.table[second] == marks).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()


def _digests(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines as written, and the digest of each line's key (empty for an empty key)."""
    lines = text.split(b"\n")
    keys = [line.strip(SPACES) for line in text.lower().split(b"\n")]
    return lines, [xxhash.xxh3_128_digest(key) if key else b"" for key in keys]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return pairs[:, 0], pairs[:, 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def count_lines(docs: DataFrame) -> DataFrame:
    """Reference counts (hi, lo, n_docs) of the lines of ``docs``: documents by line key."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            found: dict[bytes, int] = {}
            for text in texts:
                for digest in set(_digests(text)[1]):
                    found[digest] = found.get(digest, 0) + 1
            found.pop(b"", None)
            hi, lo = _halves(list(found))
            counts = pa.array(found.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([_signed(hi), _signed(lo), counts], ["hi", "lo", "n_docs"])

    parts = _texts(docs).mapInArrow(counted, "hi long, lo long, n_docs long")
    return parts.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"))


def add_documents(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Reference counts after ``docs`` came in."""
    return _changed(counts, count_lines(docs))


def remove_documents(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Reference counts after ``docs``, all counted before, were deleted."""
    return _changed(counts, count_lines(docs).withColumn("n_docs", -F.col("n_docs")))


def _changed(counts: DataFrame, change: DataFrame) -> DataFrame:
    both = counts.unionByName(change).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"))
    return both.where("n_docs > 0")


def shard_count(counts: DataFrame, least: int) -> int:
    """Shards for which the frequent keys stay below KEYS_PER_SHARD each, with room to grow."""
    return 1 + 2 * counts.where(F.col("n_docs") >= least).count() // KEYS_PER_SHARD


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))


def _filter_keys(rows: pd.DataFrame) -> np.ndarray:
    return rows["lo"].to_numpy(np.int64).view(np.uint64)


def build_filters(counts: DataFrame, least: int, shards: int) -> DataFrame:
    """A cuckoo filter (shard, slots) over the keys found in at least ``least`` documents."""

    def built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = len(rows)
        while not (made := CuckooFilter(size)).insert(_filter_keys(rows)):
            size *= 2
        return pd.DataFrame({"shard": [key[0]], "slots": [made.to_bytes()]})

    frequent = _with_shard(counts.where(F.col("n_docs") >= least), shards)
    return frequent.groupBy("shard").applyInPandas(built, "shard int, slots binary")


def update_filters(
    filters: DataFrame, before: DataFrame, after: DataFrame, least: int, shards: int
) -> DataFrame:
    """The filters after the counts changed: keys that fell below ``least`` go, others come.

    A shard without room for its new keys is built anew from the exact counts.
    """
    was, now = (F.coalesce(F.col(c), F.lit(0)) >= least for c in ("was", "now"))
    old = before.select("hi", "lo", F.col("n_docs").alias("was"))
    new = after.select("hi", "lo", F.col("n_docs").alias("now"))
    crossed = _with_shard(old.join(new, ["hi", "lo"], "full").where(was != now), shards)

    def updated(key: tuple, stored: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(table=stored["slots"][0]) if len(stored) else CuckooFilter(len(rows))
        comes = (rows["now"].fillna(0) >= least).to_numpy(bool)
        made.delete(_filter_keys(rows[~comes]))
        fits = made.insert(_filter_keys(rows[comes]))
        return pd.DataFrame({"shard": [key[0]], "slots": [made.to_bytes() if fits else None]})

    changed = filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
    changed = changed.applyInPandas(updated, "shard int, slots binary")
    full = changed.where("slots IS NULL").select("shard")
    anew = build_filters(_with_shard(after, shards).join(full, "shard", "left_semi").drop("shard"), least, shards)
    return changed.where("slots IS NOT NULL").unionByName(anew)


def _finds(docs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(text_key, hi, lo) of the lines that the filters let through, once for each text."""
    spark = docs.sparkSession
    size = filters.agg(F.sum(F.length("slots"))).first()[0] or 0
    sent = None
    if size <= FILTER_BYTES:
        sent = spark.sparkContext.broadcast({r.shard: bytes(r.slots) for r in filters.collect()})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if sent is None else {s: CuckooFilter(table=t) for s, t in sent.value.items()}
        for batch, texts in slices(batches):
            rows = [(key, list(set(_digests(text)[1]) - {b""})) for key, text in zip(batch.column(0).to_pylist(), texts, strict=True)]
            hi, lo = _halves([d for _, digests in rows for d in digests])
            keys = np.repeat(np.array([k for k, _ in rows], np.int64), [len(d) for _, d in rows])
            if tables is not None:
                shard = np.mod(hi.view(np.int64), shards)
                passed = np.zeros(len(hi), bool)
                for number, table in tables.items():
                    own = np.flatnonzero(shard == number)
                    passed[own] = table.contains(lo[own])
                keys, hi, lo = keys[passed], hi[passed], lo[passed]
            yield pa.RecordBatch.from_arrays([pa.array(keys), _signed(hi), _signed(lo)], ["text_key", "hi", "lo"])

    schema = "text_key long, hi long, lo long"
    keyed = docs.select(F.xxhash64("text").alias("text_key"), "text")
    lines = keyed.mapInArrow(found, schema)
    return lines if sent is not None else _met_in_shards(lines, filters, shards)


def _met_in_shards(lines: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The lines that their shard's filter lets through, where they meet it instead of its being sent."""

    def passed(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.select(["text_key", "hi", "lo"])
        if not len(right) or not len(own):
            return own.slice(0, 0)
        table = CuckooFilter(table=right["slots"][0].as_py())
        return own.filter(pa.array(table.contains(own["lo"].to_numpy().view(np.uint64))))

    met, tables = dealt(lines.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")), filters, "text_key")
    keys = ("shard", "piece")
    return met.groupBy(*keys).cogroup(tables.groupBy(*keys)).applyInArrow(passed, "text_key long, hi long, lo long")


def _without(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    rows = []
    for text, digests in zip(texts, dropped, strict=True):
        gone = set(digests) if digests is not None else ()
        lines, keys = _digests(text.encode())
        kept = [line for line, key in zip(lines, keys, strict=True) if not (gone and key in gone)]
        rows.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def drop_lines(
    docs: DataFrame, counts: DataFrame, filters: DataFrame, least: int, shards: int
) -> DataFrame:
    """(doc, text, n_lines, n_dropped): each row of ``docs`` as a struct, and what is left of its text.

    Rows meet their dropped lines by a hash of the text; two texts of one hash may share a list,
    which holds frequent keys only and so drops the same lines.
    """
    texts = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    frequent = counts.where(F.col("n_docs") >= least).select("hi", "lo")
    exact = _finds(texts.select("text"), filters, shards).join(frequent, ["hi", "lo"], "left_semi")
    digest = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo")]))
    gone = exact.groupBy("text_key").agg(F.collect_set(digest).alias("gone"))
    met = texts.withColumn("text_key", F.xxhash64("text")).join(gone, "text_key", "left")
    without = F.pandas_udf(_without, "text string, n_lines long, n_dropped long")
    return met.select("doc", without("text", "gone").alias("left")).select("doc", "left.*")


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``docs`` (as struct doc) with the text left after lines found in ``least`` documents went.

    The reference counts are written to the shared folder, so a lost executor costs no recount.
    """
    spark = docs.sparkSession
    path = new_table_path(spark, "line-counts")
    count_lines(docs).write.parquet(path)
    counts = spark.read.parquet(path)
    shards = shard_count(counts, least)
    return drop_lines(docs, counts, build_filters(counts, least, shards), least, shards)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: lines whose key is in at least 10 documents go."""
    kept = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY r, doc_id
"""
