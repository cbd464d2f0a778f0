"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (random signs and a Hadamard transform,
three times over) and assigned to the nearest signed axis, once for each of TABLES tables. A
query looks into the nearest axes of every table, PROBE_SHARE of them and so the more the higher
the dimension; whatever it meets is scored by its exact cosine, in double precision, on the
original vectors. A query that meets fewer rows than asked for, as in a small table or among few
vectors of its dimension, is asked again of every row.

The queries are a stated set and go to the tasks in blocks of QUERY_BLOCK, each block against
the whole index; every task keeps the nearest rows of its own part, and those meet at the end.
Rows of one vector have one cosine, and ties go to the smaller id, so of each vector only as
many rows as asked for, and one for the query's own, can be among the nearest: the index
holds those. Repeated rows of one id and vector count once.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without an id. Vectors of another dimension than the query's are no candidates. With
fewer candidates than asked for, all of them are returned; an empty table has no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import read_table
from gradeworks.session import new_table_path

NEAREST = 5
QUERY_STEP = 50
TABLES = 24
PROBE_SHARE = 3 / 64
QUERY_BLOCK = 4096

_TURNS = 3
_SEED = 64_007
_ROWS = 2048


def _turned(rows: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The rows after random signs and a Hadamard transform, for each line of signs."""
    for line in signs:
        rows = rows * line
        step = 1
        while step < rows.shape[1]:
            halves = rows.reshape(len(rows), -1, 2, step)
            left, right = halves[:, :, 0], halves[:, :, 1]
            rows = np.stack([left + right, left - right], axis=2).reshape(len(rows), -1)
            step *= 2
        rows = rows / np.sqrt(rows.shape[1])
    return rows


class AxisTables:
    """The tables' rotations for vectors of one dimension."""

    def __init__(self, dimension: int) -> None:
        self.width = 1 << max(0, dimension - 1).bit_length()
        draw = np.random.default_rng([_SEED, dimension])
        self.signs = draw.choice([-1.0, 1.0], (TABLES, _TURNS, self.width))

    def _axes(self, unit: np.ndarray, table: int) -> np.ndarray:
        padded = np.zeros((len(unit), self.width))
        padded[:, : unit.shape[1]] = unit
        turned = _turned(padded, self.signs[table])
        return np.concatenate([turned, -turned], axis=1)

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        return self._axes(unit, table).argmax(axis=1)

    def probes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Whether each query looks into each bucket."""
        axes = self._axes(unit, table)
        probes = max(2, math.ceil(axes.shape[1] * PROBE_SHARE))
        taken = np.argpartition(-axes, min(probes, axes.shape[1]) - 1, axis=1)[:, :probes]
        looks = np.zeros(axes.shape, bool)
        np.put_along_axis(looks, taken, True, axis=1)
        return looks


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class QueryBlock:
    """Queries of any dimensions, with the buckets they look into; those asked of every row need none."""

    def __init__(self, ids: list[int], vectors: list[list[float]], every_row: bool) -> None:
        self.by_dimension, self.every_row = {}, every_row
        for dimension in {len(v) for v in vectors}:
            own = [i for i, v in enumerate(vectors) if len(v) == dimension]
            unit, tables = _unit(np.array([vectors[i] for i in own], float)), AxisTables(dimension)
            looks = [] if every_row else [tables.probes(unit, t) for t in range(TABLES)]
            self.by_dimension[dimension] = (np.array([ids[i] for i in own]), unit, tables, looks)

    def search(self, dimension: int, ids: np.ndarray, rows: np.ndarray, nearest: int) -> tuple:
        """(query, id, cosine) of each query's nearest among the rows met in a table."""
        queries, own, tables, looks = self.by_dimension[dimension]
        unit = _unit(rows)
        met = np.full((len(queries), len(rows)), self.every_row)
        for table in range(len(looks)):
            met |= looks[table][:, tables.buckets(unit, table)]
        met &= queries[:, None] != ids
        at, row = np.nonzero(met)
        cosine = np.concatenate([
            np.einsum("ij,ij->i", own[a], unit[r])
            for a, r in zip(np.array_split(at, 1 + len(at) // 65536), np.array_split(row, 1 + len(at) // 65536), strict=True)
        ])
        return best_of(queries[at], ids[row], cosine, nearest)


def best_of(queries: np.ndarray, ids: np.ndarray, cosine: np.ndarray, nearest: int) -> tuple:
    """The nearest of each query: largest cosine first, ties to the smaller id."""
    order = np.lexsort((ids, -cosine, queries))
    queries, ids, cosine = queries[order], ids[order], cosine[order]
    first = np.searchsorted(queries, queries, side="left")
    kept = np.arange(len(queries)) - first < nearest
    return queries[kept], ids[kept], cosine[kept]


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, v in double precision."""
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    typed = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    return typed.where(F.col("vec_id").isNotNull() & fine & F.exists(v, lambda x: x != 0))


def nearest_neighbours(rows: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    copies = Window.partitionBy("v").orderBy("vec_id")
    index = usable(rows).withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= nearest + 1)
    index = index.select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    asked = usable(queries).dropDuplicates(["vec_id", "v"])
    path = new_table_path(spark, "neighbours")
    _ranked(_searched(index, asked, nearest, every_row=False), nearest).write.parquet(path)
    found = spark.read.parquet(path)
    full = found.where(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    again = _ranked(_searched(index, short, nearest, every_row=True), nearest)
    answered = found.join(full.withColumnRenamed("vec_id", "query_id").distinct(), "query_id", "left_semi")
    return answered.select(*again.columns).unionByName(again)


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, asked: DataFrame, nearest: int, every_row: bool) -> DataFrame:
    """(query_id, vec_id, score) of what each part of the index has nearest to each query, block by block."""
    spark = index.sparkSession
    schema = "query_id long, vec_id long, score double"

    def searcher(sent):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, best = sent.value, [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            for batch in batches:
                for start in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(start, _ROWS)
                    ids, vectors = part.column(0).to_numpy(), part.column(1)
                    sizes = vectors.value_lengths().to_numpy()
                    for dimension in block.by_dimension.keys() & set(sizes.tolist()):
                        own = np.flatnonzero(sizes == dimension)
                        values = vectors.take(pa.array(own)).flatten().to_numpy().reshape(-1, dimension)
                        found = block.search(dimension, ids[own], values, nearest)
                        best = best_of(*(np.concatenate(x) for x in zip(best, found, strict=True)), nearest)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "vec_id", "score"])

        return search

    blocks = -(-asked.count() // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], schema)
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()
        sent = spark.sparkContext.broadcast(QueryBlock([r.vec_id for r in own], [list(r.v) for r in own], every_row))
        part = index.mapInArrow(searcher(sent), schema)
        found = part if found is None else found.unionByName(part)
    return found


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every embedding whose id is divisible by QUERY_STEP."""
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))
