"""SimHash near-dedup with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles.
Documents of one fingerprint form a class; classes link when their fingerprints differ in at
most ``radius`` bits, and linked classes form components.

Links are found in BK-trees, one for each shard. The fingerprint is cut into radius + 1 or more
blocks of bits, the more the more fingerprints there are. Two fingerprints within the radius differ
in as many blocks at most, so they agree on all blocks of one choice of the others: a fingerprint
goes to a shard for each choice, by the blocks' values, and no link is lost. A shard that is still
large is cut into pieces of at most PIECE members, and each pair of pieces is a unit of work with a
tree over one and the members of the other streamed past. A unit emits a spanning set of its links,
never all pairs of a group.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. Fewer words than a shingle: the
whole sequence; no words, or an empty or null text: fingerprint zero, linked like any other. Texts
of any length are taken whole. Null ids are left out when the smallest id of a component is taken.
Repeated rows and ties each have their row in the result; an empty table has none. Other columns
are not read, and are carried along whole where one document of each group is kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import SENT_SHARDS, read_table, slices
from gradeworks.llm.components import component_of
from gradeworks.session import new_table_path

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
PIECE = 8192


class BKTree:
    """Numbers under the Hamming distance; a child's key is its distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, number: int) -> None:
        if self.root is None:
            self.root = (number, {})
            return
        value, children = self.root
        while distance := (value ^ number).bit_count():
            if distance not in children:
                children[distance] = (number, {})
                return
            value, children = children[distance]

    def within(self, number: int, radius: int) -> list[int]:
        """All stored numbers at most ``radius`` away; only edges that can lead there are followed."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            value, children = open_nodes.pop()
            distance = (value ^ number).bit_count()
            if distance <= radius:
                found.append(value)
            if children:
                least, most = distance - radius, distance + radius
                open_nodes += [node for edge, node in children.items() if least <= edge <= most]
        return found


def _shingle_hashes(text: bytes, words_each: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    row = b" ".join(words)
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(row, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts.tolist(), ends[words_each - 1 :].tolist(), strict=False)
    digest = xxhash.xxh64_intdigest
    return [digest(row[a:b], SEED) for a, b in spans]


def majority(hashes: list[int]) -> int:
    """The number whose bits are set in over half of the hashes."""
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_in = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp) of every row; fp holds the 64 bits as a signed number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [majority(h) if (h := _shingle_hashes(t, words_each)) else 0 for t in texts]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(made, "doc_id long, text_key long, fp long")


def _blocks(count: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each of so many blocks of the 64."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_count(fingerprints_at_most: int, radius: int) -> int:
    """Blocks for which a shard of evenly spread fingerprints stays within a piece."""
    count = radius + 1
    while fingerprints_at_most > PIECE << (64 * (count - radius) // count) and count < 2 * radius + 2:
        count += 1
    return count


def _shards(fp: Column, radius: int, count: int) -> Column:
    """A shard for each choice of ``count`` - radius blocks, by the values of the blocks.

    Two fingerprints within the radius differ in as many blocks at most, so they agree on all
    blocks of one choice.
    """
    blocks = [F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)) for first, bits in _blocks(count)]
    choices = itertools.combinations(range(count), count - radius)
    keys = [F.xxhash64(F.lit(i), *[blocks[b] for b in chosen]) for i, chosen in enumerate(choices)]
    return F.explode(F.array(*keys))


def _link_units(frame: pd.DataFrame, radius: int) -> Iterator[tuple[int, int]]:
    """Links that span what is linked between the members of a unit's two pieces."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, stored = BKTree(), frame["stored"].to_numpy(bool)
    alone = not (~stored).any()
    numbers = frame["fp"].to_numpy(np.int64).view(np.uint64)
    for number in numbers[stored].tolist():
        if alone:
            for other in tree.within(number, radius):
                if (x := root(number)) != (y := root(other)):
                    parent[max(x, y)] = min(x, y)
                    yield number, other
        tree.add(number)
    for number in numbers[~stored].tolist():
        for other in tree.within(number, radius):
            if (x := root(number)) != (y := root(other)):
                parent[max(x, y)] = min(x, y)
                yield number, other


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, at_most: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever is within ``radius`` bits, of distinct ``fp``.

    ``at_most`` bounds the number of fingerprints; they are counted if it is not given.
    """
    blocks = block_count(prints.count() if at_most is None else at_most, radius)
    members = prints.select("fp", _shards(F.col("fp"), radius, blocks).alias("shard"))
    pieces = members.groupBy("shard").agg(F.ceil(F.count("*") / PIECE).alias("pieces")).where("pieces > 1")
    # With radius + 1 blocks there are (radius + 1) * 2^(64 / (radius + 1)) shards at most, 41,000 for a
    # radius of 4. With more blocks only uneven shards have pieces; they are counted.
    if blocks == radius + 1 or pieces.limit(SENT_SHARDS + 1).count() <= SENT_SHARDS:
        pieces = F.broadcast(pieces)
    cut = members.join(pieces, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    units = units.select(
        "fp",
        "shard",
        F.least("own", "other").alias("one"),
        F.greatest("own", "other").alias("two"),
        (F.col("own") <= F.col("other")).alias("stored"),
    )
    keys = ["shard", "one", "two"]

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by unit; only the unit that is not complete is carried over.
        rest: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
            rest, done = frame[last], frame[~last]
            yield _links_of(done, keys, radius)
        if rest is not None:
            yield _links_of(rest, keys, radius)

    dealt = units.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp")
    return dealt.mapInPandas(linked, "a long, b long")


def _links_of(frame: pd.DataFrame, keys: list[str], radius: int) -> pd.DataFrame:
    found: list[tuple[int, int]] = []
    values = frame[keys].to_numpy()
    starts = np.flatnonzero(np.any(values[1:] != values[:-1], axis=1)) + 1 if len(values) else []
    edges = [0, *starts, len(frame)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > 1:
            found += _link_units(frame.iloc[a:b], radius)
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fp, component_id, component_key) of every row.

    component_id is the smallest id reachable (null if there are null ids only), and
    component_key the text_key of the row that has it.
    The fingerprints are written to the shared folder, as they are read more than once.
    """
    spark = docs.sparkSession
    path = new_table_path(spark, "fingerprints")
    fingerprints(docs, words_each).write.parquet(path)
    prints = spark.read.parquet(path)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("smallest")
    classes = prints.groupBy("fp").agg(smallest)
    roots = component_of(fingerprint_links(prints.select("fp").distinct(), radius, prints.count()))
    rooted = classes.join(roots, classes.fp == roots.node, "left")
    rooted = rooted.select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    found = rooted.groupBy("root").agg(F.min("smallest").alias("smallest"))
    of_class = rooted.select("fp", "root").join(found, "root")
    first = F.col("smallest.doc_id").alias("component_id"), F.col("smallest.text_key").alias("component_key")
    return prints.join(of_class.select("fp", *first), "fp")


def one_of_each(docs: DataFrame, words_each: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs``, with all its columns, with one row of each component: that of the smallest id.

    Of rows that repeat one id and text one stays.
    """
    found = near_duplicates(docs, words_each, radius)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    keys = ["none", "id", "key"]

    def keyed(doc_id: Column, text_key: Column) -> list[Column]:
        return [doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), text_key.alias("key")]

    kept = found.where(first).select(*keyed(F.col("doc_id"), F.col("text_key"))).distinct()
    text_key = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.struct("*").alias("doc"), *keyed(F.col("doc_id").cast("long"), text_key))
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    rows = rows.join(kept, keys, "left_semi").withColumn("copy", copy).where("copy = 1")
    return rows.select("doc.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
