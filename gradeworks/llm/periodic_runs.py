"""Periodic runs of words, found with longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q, at least REPEATS periods and
SHORTEST words long, that no neighbouring word extends. Runs are enumerated on harmonic grids:
for each period q the places 0, 3q, 6q, ... are compared with the place q words further on. A
run of four periods covers one of these pairs, and its ends are the longest common extensions
of the pair to the right and to the left. A stretch found for q and for a multiple of q has the
same ends both times; the smallest period stands.

An extension compares a few words first, which settles nearly all pairs. Those still equal reach
a place where both sides are sampled: of every MODULUS places those of a difference cover are,
whose differences are all the numbers below MODULUS. Only sampled suffixes are sorted, in blocks
of MODULUS words: equal blocks get equal names, checked word by word, and names of one, two, four
... blocks order the suffixes. The common blocks of two suffixes are the fewest among those of
neighbours between them, which a sparse table gives at once; less than a block of words is left
to compare. All of it is exact.

A task holds a few megabytes of texts, or one longer text whole; no rows move. Time is close to
words times the logarithm of the longest text, whatever the repeats. Null and empty texts, and
those of white space only, have no words and no runs. Rows are taken one by one: ties and
repeated rows each have their result, null ids too. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import distinct_words, read_table, rolling_hash, slices

REPEATS = 4
SHORTEST = 6
# Every difference modulo MODULUS lies between two of the cover.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])


def _steps_to_cover() -> np.ndarray:
    """For two residues the number of steps until both are in the cover."""
    steps = np.full((MODULUS, MODULUS), MODULUS)
    for a in COVER.tolist():
        for b in COVER.tolist():
            for back in range(MODULUS):
                here = (a - back) % MODULUS, (b - back) % MODULUS
                steps[here] = min(steps[here], back)
    return steps


_STEPS = _steps_to_cover()
_CLASS = np.full(MODULUS, -1)
_CLASS[COVER] = np.arange(len(COVER))


def _closed(symbols: np.ndarray) -> np.ndarray:
    """The symbols (not negative) and after them enough others that occur nowhere else."""
    return np.concatenate([symbols, -1 - np.arange(3 * MODULUS)])


def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """How many symbols from a and b on are the same, counting to ``most``."""
    count, left = np.zeros(len(a), np.int64), np.arange(len(a))
    limit = np.broadcast_to(most, len(a))
    step = 0
    while len(left):
        left = left[limit[left] > step]
        left = left[symbols[a[left] + step] == symbols[b[left] + step]]
        count[left] += 1
        step += 1
    return count


class CommonExtensions:
    """Longest common extensions to the right of any two places of a sequence of symbols."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = _closed(symbols)
        length = len(symbols) + MODULUS
        classes = [np.arange(r, length, MODULUS) for r in COVER]
        places = np.concatenate(classes)
        self.starts = np.cumsum([0, *map(len, classes)])
        levels = [self._block_names(places)]
        span, count = 1, len(places)
        while levels[-1].max() + 1 < count:
            after = np.full(count, -1)
            for start, end in zip(self.starts, self.starts[1:], strict=False):
                after[start : max(start, end - span)] = levels[-1][start + span : end]
            levels.append(np.unique(levels[-1] * (count + 1) + after + 1, return_inverse=True)[1])
            span *= 2
        self.ranks = levels[-1]
        order = np.argsort(self.ranks)
        x, y = order[:-1].copy(), order[1:].copy()
        for level in range(len(levels) - 2, -1, -1):
            same = (levels[level][x] == levels[level][y]).astype(np.int64) << level
            x += same
            y += same
        shared = x - order[:-1]
        self.least = [shared]
        while 2 << len(self.least) <= 2 * len(shared):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _block_names(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the blocks that begin at the places; equal numbers for equal blocks only."""
        for turn in range(100):
            hashes = rolling_hash(self.symbols.view(np.uint64), MODULUS, 0x9E3779B97F4A7C15 + 2 * turn)[places]
            _, first, names = np.unique(hashes, return_index=True, return_inverse=True)
            same = places[first][names]
            if all((self.symbols[places + k] == self.symbols[same + k]).all() for k in range(MODULUS)):
                return names
        raise RuntimeError("no hash tells the blocks apart")

    def _sampled(self, places: np.ndarray) -> np.ndarray:
        return self.ranks[self.starts[_CLASS[places % MODULUS]] + places // MODULUS]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        steps = _STEPS[a % MODULUS, b % MODULUS]
        found = _common(self.symbols, a, b, steps)
        far = np.flatnonzero(found == steps)
        one, two = (self._sampled(x[far] + steps[far]) for x in (a, b))
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            table = self.least[k]
            found[far[own]] += MODULUS * np.minimum(table[low[own]], table[high[own] - (1 << k)])
        # The first blocks that differ may begin alike.
        found[far] += _common(self.symbols, a[far] + found[far], b[far] + found[far], MODULUS)
        return found


def _grid_pairs(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the grids whose word is that one period further on, and the periods."""
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for q in range(1, longest // REPEATS + 1):
        step = (REPEATS - 1) * q
        ahead = symbols[q::step]
        found = np.flatnonzero(symbols[::step][: len(ahead)] == ahead) * step
        if len(found):
            places.append(found)
            periods.append(np.full(len(found), q))
    return np.concatenate(places), np.concatenate(periods)


def find_runs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, in that order.

    ``codes`` are the words of all texts in a row, as numbers; text i has those from
    ``starts[i]`` to ``starts[i + 1]``.
    """
    sizes = np.diff(starts)
    # A mark of its own after each text keeps runs inside.
    marks = codes.max(initial=0) + 1 + np.arange(len(sizes))
    symbols = np.insert(codes.astype(np.int64), starts[1:], marks)
    firsts = starts[:-1] + np.arange(len(sizes))
    place, period = _grid_pairs(symbols, int(sizes.max(initial=0)))
    # The words of a pair in two texts have a mark between them, so that they are in no run.
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = text[place] == text[place + period]
    place, period = place[inside], period[inside]
    forward, backward = _closed(symbols), _closed(symbols[::-1])
    mirror = len(symbols) - 1
    right = _common(forward, place, place + period, MODULUS)
    left = _common(backward, mirror - place - period, mirror - place, MODULUS)
    due = np.maximum(SHORTEST, REPEATS * period) - period
    unsettled = (right == MODULUS) | (left == MODULUS)
    kept = unsettled | (right + left - 1 >= due)
    place, period, right, left, due, unsettled = (x[kept] for x in (place, period, right, left, due, unsettled))
    if unsettled.any():
        own, which = np.unique(text[place[unsettled]], return_inverse=True)
        parts = [symbols[firsts[i] : firsts[i] + sizes[i] + 1] for i in own.tolist()]
        moved = np.cumsum([0, *map(len, parts)])[:-1][which] - firsts[own][which]
        part = np.concatenate(parts)
        a, b = place[unsettled] + moved, (place + period)[unsettled] + moved
        right[unsettled] = CommonExtensions(part)(a, b)
        mirror = len(part) - 1
        left[unsettled] = CommonExtensions(part[::-1].copy())(mirror - b, mirror - a)
    same = right + left - 1
    kept = same >= due
    start, length, period = (place - left + 1)[kept], (same + period)[kept], period[kept]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    again = np.zeros(len(start), bool)
    again[1:] = (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    start, length, period = start[~again], length[~again], period[~again]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(firsts, start, side="right") - 1
    return text, start - firsts[text], length, period


def strongest(start: list[int], length: list[int], period: list[int]) -> int:
    """Which run has the greatest exact length over period; ties go to the smaller start, then period."""
    return max(range(len(start)), key=lambda i: (Fraction(length[i], period[i]), -start[i], -period[i]))


_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
    "start long, length long, period long, collapsed string"
)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text): all runs by start and period, the strongest, the collapsed text.

    The collapsed text holds the words that no run has after its first period, joined by blanks.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches):
            words, codes, starts = distinct_words(batch.column(1))
            text, *runs = find_runs(codes, starts)
            kept = np.zeros(len(codes) + 1, np.int64)
            first = starts[text] + runs[0] + runs[2]
            np.add.at(kept, first, 1)
            np.add.at(kept, starts[text] + runs[0] + runs[1], -1)
            kept = np.cumsum(kept[:-1]) == 0
            left = codes[kept].tolist()
            ends = np.concatenate([[0], np.cumsum(kept)])[starts].tolist()
            collapsed = [b" ".join([words[c] for c in left[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1))
            best: list[list[int | None]] = [[None] * batch.num_rows for _ in runs]
            for i in np.unique(text).tolist():
                own = [x[offsets[i] : offsets[i + 1]].tolist() for x in runs]
                at = strongest(*own)
                for column, values in zip(best, own, strict=True):
                    column[i] = values[at]
            structs = pa.StructArray.from_arrays([pa.array(x) for x in runs], fields=list(run))
            columns = [
                batch.column(0),
                pa.array(np.diff(starts)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), structs),
                *[pa.array(column, pa.int64()) for column in best],
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ]
            names = ["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(found, _SCHEMA)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten repeats its words from some place on with some period, by its id's checksum.

    From word a on, word i becomes word a + (i - a) % p. A null id has no checksum and is left as it is.
    """
    words, n, a, p = F.col("words"), F.size("words"), F.col("a"), F.col("p")
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(checksum % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0))
    # Dividing by ten, the remainder is 0 where it matters.
    g = (checksum - checksum % 10) / 10
    cut = docs.select("doc_id", F.col("text").cast("string").alias("text"), chosen.alias("words"), g.cast("long").alias("g"))
    cut = cut.withColumn("a", F.when(n > 0, F.col("g") % F.greatest(n, F.lit(1))).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    turns = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return cut.select("doc_id", F.when(a.isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with the planted ones."""
    found = periodic_runs(_with_planted_runs(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.floor(F.col("length") * 1000 / F.col("period")).cast("long").alias("exponent_milli"),
        _digest(lines).alias("runs_sha256"),
        _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
