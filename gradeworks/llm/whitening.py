"""Whitening of embeddings by contour integration of their covariance.

Entries are put on a grid of 1/STEPS and counted from OFFSET, so that sums over the corpus are
exact whole numbers. The fit list holds each distinct vector once. Its sums and its centred
products are added up by Spark and only they, d and d x d numbers, come to the driver.

The leading components of the covariance V are found by FEAST. V is brought to three diagonals,
whose inertia at a shift tells how many eigenvalues lie above it; bisection with these counts
cuts the top of the spectrum into intervals of a few eigenvalues each. For every interval and
every node of a quadrature on the circle around it, one Spark task solves the shifted complex
system for a block of directions; the weighted sum projects the block onto the interval's
eigenspace, and Rayleigh-Ritz takes the components out of it. This repeats until residuals are
at rounding level and every interval has as many components as its inertia says, so none is
missed. Eigenvalues below FLOOR of the largest are rounding noise and count as zero.

Rows whose vector is null or holds a null or non-finite entry are left out; every other row is
projected, repeated rows and rows of a null id too. Vectors of several dimensions are fitted
dimension by dimension. Empty vectors, and vectors all alike, have no component with a variance
and so no rows; there are fewer than ``most`` components where the vectors span fewer
directions. Equal eigenvalues have any orthonormal directions of their space. Entries beyond
LIMIT grid steps are taken as LIMIT. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import read_table
from gradeworks.session import new_table_path

MOST = 16
STEPS = 64
OFFSET = 1_000_000
LIMIT = 1 << 51
FLOOR = 1e-11

# Eigenvalues of an interval and its ends' ratio at most, nodes of its quadrature, repetitions
# until it must have settled.
_GROUP = 8
_RATIO = 4.0
_NODES = 8
_TURNS = 20
_RESIDUAL = 2e-14
_LOW = 26
_ROWS = 4096


def on_grid(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part, x as whole numbers."""
    v = F.col("v")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    typed = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    bound = F.lit(float(LIMIT))
    step = lambda c: F.floor(F.greatest(F.least(c * STEPS, bound), -bound)).cast("long") + OFFSET
    return typed.where(v.isNotNull() & fine).select("vec_id", F.transform(v, step).alias("x"))


def distinct_vectors(points: DataFrame) -> DataFrame:
    """(x): each distinct vector once, written to the shared folder; copies fall together in the tasks first."""
    path = new_table_path(points.sparkSession, "vectors")
    points.select("x").distinct().write.parquet(path)
    return points.sparkSession.read.parquet(path)


@dataclass
class Fit:
    """What is known of the fit list of one dimension; eigenvalues fall."""

    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    identity_error: float = 0.0

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; only the last subtraction rounds."""
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; null where it does not fit 64 bits."""
        from_whole = x - self.whole
        near = ((from_whole.astype(float) * self.n - self.rest) ** 2).sum(axis=1) / 2.0**63
        with np.errstate(over="ignore"):
            sums = ((from_whole * self.n - self.rest) ** 2).sum(axis=1)
        found: list[int | None] = sums.tolist()
        for i in np.flatnonzero(near > 0.999).tolist():
            exact = None
            if near[i] < 1.001:
                ways = zip(from_whole[i].tolist(), self.rest.tolist(), strict=True)
                exact = sum((a * self.n - b) ** 2 for a, b in ways)
            found[i] = exact if exact is not None and exact < 1 << 63 else None
        return found


def vector_sums(distinct: DataFrame) -> dict[int, Fit]:
    """Number and sums of the vectors, by dimension. High and low digits are added apart, which stays exact."""
    entries = distinct.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "e"))
    high, low = F.sum(F.shiftright("e", _LOW)), F.sum(F.col("e").bitwiseAND(F.lit((1 << _LOW) - 1)))
    rows = entries.groupBy("d", "i").agg(F.count("*").alias("n"), high.alias("high"), low.alias("low"))
    found: dict[int, list] = {}
    for row in sorted(rows.collect(), key=lambda r: (r.d, r.i)):
        found.setdefault(row.d, []).append((row.n, (row.high << _LOW) + row.low))
    return {d: Fit(own[0][0], [s for _, s in own]) for d, own in found.items()}


def _matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension: it, the places of its rows and their vectors, at most _ROWS together."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in sorted(set(sizes.tolist()) - {0}):
        own = np.flatnonzero(sizes == d)
        for start in range(0, len(own), _ROWS):
            part = own[start : start + _ROWS]
            yield d, part, column.take(pa.array(part)).flatten().to_numpy().reshape(-1, d)


def _moments(distinct: DataFrame, fits: dict[int, Fit], make: Callable[[Fit, np.ndarray], np.ndarray]) -> dict:
    """Mean and covariance of what ``make`` gives for the fit list, by dimension.

    Each task adds up one matrix a dimension; Spark adds their cells.
    """
    sent = distinct.sparkSession.sparkContext.broadcast(fits)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                made = make(sent.value[d], x)
                made = np.concatenate([made, np.ones((len(made), 1))], axis=1)
                sums[d] = sums.get(d, 0) + made.T @ made
        for d, matrix in sums.items():
            upper = matrix[np.triu_indices(len(matrix))]
            columns = [np.full(len(upper), d, np.int32), np.arange(len(upper)), upper]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "cell", "s"])

    cells = distinct.mapInArrow(added, "d int, cell long, s double").groupBy("d", "cell").agg(F.sum("s").alias("s"))
    found: dict[int, list] = {}
    for row in sorted(cells.collect(), key=lambda r: (r.d, r.cell)):
        found.setdefault(row.d, []).append(row.s)
    moments = {}
    for d, upper in found.items():
        size = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
        matrix = np.zeros((size, size))
        matrix[np.triu_indices(size)] = upper
        matrix = (matrix + np.triu(matrix, 1).T) / fits[d].n
        mean = matrix[:-1, -1]
        moments[d] = mean, matrix[:-1, :-1] - np.outer(mean, mean)
    return moments


class Inertia:
    """How many eigenvalues of a symmetric matrix lie above a shift."""

    def __init__(self, matrix: np.ndarray) -> None:
        a = matrix.copy()
        for k in range(len(a) - 2):
            mirror = a[k + 1 :, k].copy()
            length = np.linalg.norm(mirror)
            if length == 0:
                continue
            mirror[0] += np.copysign(length, mirror[0])
            mirror /= np.linalg.norm(mirror)
            for side in (a, a.T):
                side[k + 1 :, :] -= 2 * np.outer(mirror, mirror @ side[k + 1 :, :])
        self.middle, self.beside = np.diagonal(a).copy(), np.diagonal(a, 1).copy()
        spread = np.abs(np.concatenate([[0], self.beside])) + np.abs(np.concatenate([self.beside, [0]]))
        self.bound = float((np.abs(self.middle) + spread).max())

    def above(self, shift: float) -> int:
        """Positive pivots of the matrix less the shift."""
        tiny, pivot, count = np.finfo(float).tiny ** 0.5, 1.0, 0
        for middle, beside in zip(self.middle.tolist(), [0.0, *self.beside.tolist()], strict=True):
            pivot = middle - shift - beside * beside / pivot
            if abs(pivot) < tiny:
                pivot = -tiny
            count += pivot > 0
        return count

    def intervals(self, wanted: int) -> list[tuple[float, float, int]]:
        """(low, high, eigenvalues between) that hold the ``wanted`` largest, at most; those of about zero never."""
        top = self.bound * 1.01
        if top == 0:
            return []
        low, high = self.bound * FLOOR, top
        reached = self.above(low)
        wanted = min(wanted, reached)
        if not wanted:
            return []
        # The highest shift that still has them all above it.
        while high > low * (1 + 1e-9) and self.above(low) > wanted:
            middle = (low * high) ** 0.5
            low, high = (middle, high) if self.above(middle) >= wanted else (low, middle)
        found = []

        def cut(a: float, b: float, above_a: int, above_b: int) -> None:
            if above_a == above_b:
                return
            if (above_a - above_b <= _GROUP and b <= a * _RATIO) or b < a * (1 + 1e-7):
                found.append((a, b, above_a - above_b))
                return
            middle = (a * b) ** 0.5
            between = self.above(middle)
            cut(middle, b, between, above_b)
            cut(a, middle, above_a, between)

        cut(low, top, self.above(low), 0)
        return found


def _projected(spark: SparkSession, matrix: np.ndarray, blocks: list[tuple[float, float, np.ndarray]]) -> list[np.ndarray]:
    """Each block of directions projected onto the eigenspace of its interval (low, high).

    A Spark task for every interval and node of the half circle above it; what comes back is as
    large as the blocks times the nodes, whatever the corpus.
    """
    sent = spark.sparkContext.broadcast((matrix, blocks))
    places, weights = np.polynomial.legendre.leggauss(_NODES)
    points = [(b, float(t), float(w)) for b in range(len(blocks)) for t, w in zip(places, weights, strict=True)]

    def solved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, own = sent.value
        for part in parts:
            for row in part.itertuples():
                low, high, block = own[row.block]
                turn = (high - low) / 2 * np.exp(0.5j * np.pi * (1 - row.place))
                shifted = ((low + high) / 2 + turn) * np.eye(len(v)) - v
                share = row.weight / 2 * (turn * np.linalg.solve(shifted, block.astype(complex))).real
                yield pd.DataFrame({"block": [row.block], "share": [share.tobytes()]})

    tasks = spark.createDataFrame(points, "block int, place double, weight double").repartition(len(points))
    total = [np.zeros(block.shape) for *_, block in blocks]
    for row in tasks.mapInPandas(solved, "block int, share binary").collect():
        total[row.block] += np.frombuffer(row.share).reshape(total[row.block].shape)
    sent.unpersist()
    return total


def _ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of the block: values, vectors, residuals; values fall."""
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    basis = left[:, size > size.max(initial=0) * 1e-13]
    values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    values, vectors = values[::-1], (basis @ inner)[:, ::-1]
    return values, vectors, np.linalg.norm(matrix @ vectors - vectors * values, axis=0)


def leading(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns."""
    inertia, d = Inertia(matrix), len(matrix)
    intervals = inertia.intervals(most)
    if not intervals:
        return np.empty(0), np.empty((d, 0))
    draw = np.random.default_rng(d)
    blocks = [draw.standard_normal((d, min(d, 2 * count + 4))) for *_, count in intervals]
    settled: list[np.ndarray | None] = [None] * len(intervals)
    for _ in range(_TURNS):
        due = [i for i, vectors in enumerate(settled) if vectors is None]
        if not due:
            break
        made = _projected(spark, matrix, [(*intervals[i][:2], blocks[i]) for i in due])
        for i, block in zip(due, made, strict=True):
            low, high, count = intervals[i]
            values, vectors, residuals = _ritz(matrix, block)
            # A value on the edge may fall to either side by a rounding error.
            edge = inertia.bound * _RESIDUAL
            inside = (values > low - edge) & (values <= high + edge)
            # A mean of values on both sides can lie inside as well; its residual gives it away.
            inside &= residuals <= edge * np.sqrt(d)
            if inside.sum() >= count:
                settled[i] = vectors[:, inside]
            else:  # the span found so far, and a new direction for each component still missing
                width = min(d, blocks[i].shape[1] + count - int(inside.sum()))
                new = draw.standard_normal((d, width - vectors.shape[1]))
                blocks[i] = np.concatenate([vectors, new], axis=1)
    if any(vectors is None for vectors in settled):
        raise RuntimeError("the eigenvalues found do not match the inertia of the covariance")
    # Once more over all intervals, so that vectors on both sides of a cut are orthogonal as well.
    values, vectors, _ = _ritz(matrix, np.concatenate(settled, axis=1))
    wanted = min(most, inertia.above(inertia.bound * FLOOR))
    values, vectors = values[:wanted], vectors[:, :wanted]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)]
    return values, vectors * np.where(largest < 0, -1, 1)


def fit_whitening(distinct: DataFrame, most: int = MOST) -> dict[int, Fit]:
    """Means, leading components and the error of the whitened covariance, by dimension."""
    spark, fits = distinct.sparkSession, vector_sums(distinct)
    for d, (_, covariance) in _moments(distinct, fits, Fit.centred).items():
        fits[d].trace = float(np.trace(covariance))
        fits[d].values, fits[d].vectors = leading(spark, covariance, most)
    fits = {d: fit for d, fit in fits.items() if len(fit.values)}
    used = distinct.where(F.size("x").isin(list(fits)))
    for d, (_, covariance) in (_moments(used, fits, Fit.whitened) if fits else {}).items():
        fits[d].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return fits


_NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(points: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """One row for each row of ``points`` and component."""
    # Means and components: d times ``most`` numbers for each dimension.
    sent = points.sparkSession.sparkContext.broadcast(fits)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for d, places, x in _matrices(batch.column(1)):
                fit = sent.value.get(d)
                if fit is None:
                    continue
                k, rows = len(fit.values), np.repeat(np.arange(len(x)), len(fit.values))
                columns = [
                    ids.take(pa.array(places[rows])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), fit.n)),
                    pa.array(fit.deviation(x), pa.int64()).take(pa.array(rows)),
                    pa.array(fit.whitened(x).ravel()),
                    pa.array(np.tile(fit.values / fit.trace, len(x))),
                    pa.array(np.full(len(rows), fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return points.mapInArrow(projected, _SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the leading components, scaled to unit variance."""
    points = on_grid(read_table(spark, sf_dir, "embeddings"))
    return whiten(points, fit_whitening(distinct_vectors(points)))
