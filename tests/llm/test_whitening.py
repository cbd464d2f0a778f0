"""Whitening against numpy's own eigenvalues, and its rule on whole numbers."""

import math

import numpy as np
import pytest

from conftest import SMALL
from gradeworks.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n long, x string"


def run(spark, tmp_path, rows):
    folder = str(tmp_path)
    spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return W.op11_whitening(spark, folder).collect()


def plain(rows):
    """The contract restated: kept rows, fit list, sums, covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({v for _, v in x})
    sums = [sum(v[j] for v in fit) for j in range(len(fit[0]))]
    centred = np.array([[c - s / len(fit) for c, s in zip(v, sums, strict=True)] for v in fit])
    return x, fit, sums, centred.T @ centred / len(fit)


def hold(found, rows, components):
    x, fit, sums, covariance = plain(rows)
    n, values = len(fit), np.linalg.eigvalsh(covariance)[::-1]
    assert len(found) == len(x) * components
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, r)
    whitened = {}
    for i, v in x:
        own = by_id[i]
        assert sorted(own) == list(range(1, components + 1))
        for c, r in own.items():
            assert r.n == n
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-9
        whitened[v] = [own[c].whitened for c in range(1, components + 1)]
    w = np.array([whitened[v] for v in fit])
    assert np.abs(w.mean(axis=0)).max() < 1e-9
    assert np.abs(w.T @ w / n - np.eye(components)).max() < 1e-9
    # Directions: the whitened values must be those of eigenvectors of the covariance.
    centred = np.array([[a - s / n for a, s in zip(v, sums, strict=True)] for v in fit])
    axes = centred.T @ w / n / np.sqrt(values[:components])
    assert np.abs(covariance @ axes - axes * values[:components]).max() < 1e-8 * values[0]


def test_given_embeddings(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    hold(W.op11_whitening(spark, SMALL).collect(), rows, 16)


@pytest.mark.parametrize("scales", [[1.0] * 20, [10.0 ** (-i / 6) for i in range(40)], [5.0, 5.0, 5.0, 0.1, 0.1], [3.0]])
def test_spectra(spark, tmp_path, scales):
    draw = np.random.default_rng(len(scales))
    rows = [(i, (draw.standard_normal(len(scales)) * scales * 30).tolist()) for i in range(300)]
    hold(run(spark, tmp_path, rows), rows, min(16, len(scales)))


def test_edges(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [(i, draw.standard_normal(6).tolist()) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [math.nan] * 6), (103, [math.inf] + [0.0] * 5)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(rows[1][0], rows[1][1])]
    found = run(spark, tmp_path, rows)
    hold(found, rows, 6)
    assert sum(r.vec_id == 1 for r in found) == 12


def test_fewer_directions_than_dimensions(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = [(i, [a, 2.0, a, b, 0.0]) for i, (a, b) in enumerate((draw.integers(-9, 9, (50, 2)) / 4.0).tolist())]
    hold(run(spark, tmp_path, rows), rows, 2)


def test_no_variance(spark, tmp_path):
    assert run(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, []), (None, None)]) == []


def test_dimensions_are_fitted_apart(spark, tmp_path):
    draw = np.random.default_rng(7)
    small = [(i, draw.standard_normal(3).tolist()) for i in range(30)]
    large = [(100 + i, draw.standard_normal(4).tolist()) for i in range(30)]
    found = run(spark, tmp_path, small + large)
    hold([r for r in found if r.vec_id < 100], small, 3)
    hold([r for r in found if r.vec_id >= 100], large, 4)


def test_huge_entries(spark, tmp_path):
    found = run(spark, tmp_path, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 9.0]), (None, [0.5, 0.25])])
    assert {r.vec_id for r in found} == {1, 2, 3, None}
    assert all(r.deviation is None for r in found if r.vec_id == 1)
    assert all(math.isfinite(r.whitened) for r in found)


def test_empty_table(spark, empty_folder):
    assert W.op11_whitening(spark, empty_folder).collect() == []


def test_inertia_counts():
    draw = np.random.default_rng(8)
    matrix = draw.standard_normal((30, 30))
    matrix = matrix @ matrix.T
    values, inertia = np.linalg.eigvalsh(matrix), W.Inertia(matrix)
    for shift in np.concatenate([values - 1e-6, values + 1e-6, [-1.0, 1e6]]):
        assert inertia.above(shift) == (values > shift).sum()
    low = min(a for a, _, _ in inertia.intervals(16))
    assert (values > low).sum() == sum(c for *_, c in inertia.intervals(16)) >= 16


def test_none_missed_when_directions_start_badly(spark, monkeypatch):
    """Blocks that begin without a part of some eigenvectors do not lose them."""
    values, drawn = np.arange(1.0, 25.0)[::-1], np.random.default_rng

    class Poor:
        def __init__(self, seed):
            self.inner, self.drawn = drawn(seed), 0

        def standard_normal(self, shape):
            self.drawn += 1
            block = self.inner.standard_normal(shape)
            block[:6] *= self.drawn > 3
            return block

    monkeypatch.setattr(np.random, "default_rng", Poor)
    found, vectors = W.leading(spark, np.diag(values), 16)
    assert np.allclose(found, values[:16])
    assert np.allclose(np.abs(vectors), np.eye(24)[:, :16])
