"""Runs against all stretches of all periods, and extensions against plain comparison."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from conftest import SMALL
from gradeworks.llm import periodic_runs as R
from llm.support import in_order, read_rows, words_of

NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def plain_runs(words):
    """Maximal stretches of each period, smallest period first; a stretch has its smallest period only."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(rows):
    results = []
    for doc_id, text in rows:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        results.append((doc_id, len(runs), *best, milli, *[hashlib.sha256(x).hexdigest() for x in (lines.encode(), kept)]))
    return results


def run(spark, folder):
    return [tuple(r) for r in R.op13_periodic_runs(spark, folder).select(*NAMES).collect()]


def codes_of(texts):
    flat = np.array([c for t in texts for c in t], np.int64)
    return flat, np.cumsum([0, *map(len, texts)])


def check(texts):
    found = [tuple(int(x) for x in r) for r in zip(*R.find_runs(*codes_of(texts)), strict=True)]
    assert found == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


@pytest.mark.parametrize("seed", range(40))
def test_random_texts(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(draw.randint(1, 8)):
        text = []
        for _ in range(draw.randint(0, 7)):
            part = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randint(1, draw.choice([3, 12, 60])))]
            text += part * draw.choice([1, 1, 4, 5, 9]) + part[: draw.randint(0, len(part))]
        texts.append(text)
    check(texts)


def test_structured_texts():
    fibonacci = [[0], [0, 1]]
    for _ in range(12):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    check([[0] * 700, [0, 1] * 350, ([0] * 5 + [1]) * 90, fibonacci[-1], list(range(300)) * 4, [1] * 5, [1] * 6, [], [1, 2] * 4])


@pytest.mark.parametrize("size", [150, 300])
@pytest.mark.parametrize("lead", [7, 21, 35])
def test_equal_texts_beside_a_long_one(size, lead):
    """Words that come again in the next text are in no run, however long the longest text is."""
    long, short = list(range(1000, 1000 + 5 * size)), list(range(size))
    check([list(range(5000, 5000 + lead)), long, short, short])
    check([list(range(5000, 5000 + lead)), long, short, short + [7, 8] * 5, long])


@pytest.mark.parametrize("letters", [1, 2, 40])
def test_common_extensions(letters):
    draw = np.random.default_rng(letters)
    symbols = np.concatenate([np.tile(draw.integers(0, letters, 37), 9), draw.integers(0, letters, 200), [99]])
    extend = R.CommonExtensions(symbols)
    a, b = draw.integers(0, len(symbols), (2, 3000))
    a, b = a[a != b], b[a != b]
    wanted = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        k = 0
        while max(x, y) + k < len(symbols) and symbols[x + k] == symbols[y + k]:
            k += 1
        wanted.append(k)
    assert extend(a, b).tolist() == wanted


def test_cover_has_every_difference():
    differences = {(a - b) % R.MODULUS for a in R.COVER.tolist() for b in R.COVER.tolist()}
    assert differences == set(range(R.MODULUS))


def test_colliding_names_are_told_apart(monkeypatch):
    hashed, calls = R.rolling_hash, []

    def poor(symbols, width, factor):
        calls.append(factor)
        return hashed(symbols, width, factor) % np.uint64(3 if len(calls) == 1 else 1 << 62)

    monkeypatch.setattr(R, "rolling_hash", poor)
    check([list(range(40)) * 6, [1, 2] * 100])
    assert len(calls) > 2


def test_edge_rows(spark, edge_folder):
    rows = [(i, " ".join(t.split()[:900]) if t and len(t) > 50_000 else t) for i, t in read_rows(edge_folder)]
    full = {r[0]: r for r in run(spark, edge_folder)}
    wanted = plain(rows)
    long = {i for i, t in read_rows(edge_folder) if t and len(t) > 50_000}
    assert in_order(r for r in run(spark, edge_folder) if r[0] not in long) == in_order(r for r in wanted if r[0] not in long)
    assert long <= full.keys()


def test_given_documents(spark):
    rows = read_rows(SMALL)
    short = {i for i, t in rows if len(words_of(t)) <= 2500}
    found = run(spark, SMALL)
    assert len(found) == len(rows)
    assert in_order(r for r in found if r[0] in short) == in_order(plain([r for r in rows if r[0] in short]))


def test_a_text_longer_than_a_slice(spark, documents):
    """One document of some three megabytes, a third of it one run."""
    draw = random.Random(3)
    head = [f"w{draw.randrange(90_000)}" for _ in range(400_000)]
    rows = [(3, " ".join(head + head[:40_000] * 5)), (4, "x " * 100_000)]
    assert all(zlib.crc32(str(i).encode()) % 10 for i, _ in rows)
    found = {r[0]: r for r in run(spark, documents(rows))}
    assert found[4][1:6] == (1, 0, 100_000, 1, 100_000_000)
    start, length, period = found[3][2:5]
    assert (found[3][1], period, length >= 200_000, start <= 400_000) == (1, 40_000, True, True)


def test_empty_table(spark, empty_folder):
    assert run(spark, empty_folder) == []
