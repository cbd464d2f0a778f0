import math
import random

import numpy as np
import pytest

from gradeworks.llm import nearest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def brute(rows, step=50, count=5):
    fine = {(i, tuple(v)) for i, v, _ in rows if i is not None and v is not None and usable(v)}
    for q, v in fine:
        if q % step == 0:
            found = sorted((-cosine(v, w), i) for i, w in fine if i != q and len(w) == len(v))
            yield q, [(i, -s) for s, i in found[:count]]


def check(found, wanted, recall):
    rows = {}
    for r in found:
        rows.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, best in wanted:
        own = sorted(rows.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        true = dict(best)
        for _, i, s in own:
            if i in true:
                assert s == pytest.approx(true[i], abs=1e-12)
        hits += len({i for _, i, _ in own} & set(true))
        total += len(true)
    assert hits >= recall * total


def test_recall_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = nearest.op8_nearest(spark, SMALL)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    check(found.collect(), brute(rows), 0.9)


def test_recall_of_near_copies(spark, tmp_path):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(60, 33))
    rows = [(i, (base[i % 60] + draw.normal(size=33) * 0.1).tolist(), 0) for i in range(600)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    check(nearest.op8_nearest(spark, str(tmp_path)).collect(), brute(stored), 0.98)


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same, 0) for i in range(0, 120)] + [(0, same, 1), (7, same, 1)]
    rows += [(200 + i, v, 0) for i, v in enumerate([None, [], [0.0] * 4, [nan, 1.0, 1.0, 1.0], [inf, 1.0, 1.0, 1.0]])]
    rows += [(250, [None, 1.0, 2.0, 3.0], 0), (300, [1.0, 0.0], 0), (301, [1.0, 0.1], 0), (None, same, 0)]
    random.Random(1).shuffle(rows)
    extra = [(*r, 1, 2) for r in rows]
    frame = spark.createDataFrame(extra, SCHEMA + ", v int, copy int")
    frame.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = nearest.op8_nearest(spark, str(tmp_path)).collect()
    ids = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100, 300)}
    assert ids == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 300: [301]}
    assert {r.query_id for r in found} == {0, 50, 100, 300}


def test_query_blocks(spark, monkeypatch):
    whole = {tuple(r) for r in nearest.op8_nearest(spark, SMALL).collect()}
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    assert {tuple(r) for r in nearest.op8_nearest(spark, SMALL).collect()} == whole


def test_empty_table(spark, empty_folder):
    assert nearest.op8_nearest(spark, empty_folder).collect() == []


@pytest.mark.parametrize("dimension", [3, 64, 384, 768])
def test_few_rows_are_all_found(spark, tmp_path, dimension):
    """Six vectors: every query has its five candidates, however far they lie."""
    draw = np.random.default_rng(dimension)
    rows = [(50 * i, draw.normal(size=dimension).tolist(), 0) for i in range(5)] + [(7, draw.normal(size=dimension).tolist(), 0)]
    rows += [(1000, [1.0, 2.0], 0), (1001, [-1.0, -2.0], 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    found = nearest.op8_nearest(spark, str(tmp_path)).collect()
    assert len(found) == 5 * 5 + 1
    check(found, brute(stored), 1)


@pytest.mark.parametrize("dimension", [64, 384, 768])
def test_recall_of_random_vectors(spark, tmp_path, dimension):
    draw = np.random.default_rng(dimension)
    values = draw.normal(size=(3000, dimension)).astype(np.float32)
    rows = [(i, v, 0) for i, v in enumerate(values.tolist())]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in nearest.op8_nearest(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    unit = values.astype(float) / np.linalg.norm(values.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        cosines = unit @ unit[q]
        cosines[q] = -2
        assert len(found[q]) == 5
        hits += len(found[q] & set(np.argsort(-cosines)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60
