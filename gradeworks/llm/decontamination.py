"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Texts are sequences of words: lower-cased, cut at ASCII white space, without punctuation at their
ends. An item of n words is found in a document when a stretch of it has an edit distance, in
words, of at most ``share`` times n to the item.

CGK walks drift apart as edits add up, so an item of more than PIECE_WORDS words is looked for by
its pieces: cut into m pieces of nearly equal length, one of them holds at most an m-th of the
edits. Any piece found makes the item a candidate. How many tables a piece needs follows from RECALL:
pieces of its length are drawn, edited as often as the share allows and embedded, and as many tables
are taken as find that part of them (``tables_for``). A share that MOST_TABLES cannot serve is refused.

For every piece length, the windows of as many words are embedded by CGK random walks: the walk
copies the word under its pointer and, by a random bit of the word and the step, moves on or
stays, which turns few edits into few differing places. Each of several walks is sampled at a
few places for each of several tables; windows and pieces that agree in a table are candidates.
Candidates are verified by an exact edit distance between the item and the stretch around.

Windows that cannot be within the distance are not embedded: k edits spoil at most 3k of the
piece's n - 2 word triples, so a window needs n - 2 - 3k triples that occur in items at all, and
likewise n - 1 - 2k pairs and n - k words. This loses nothing.

Null, empty or wordless texts and items match nothing, and stay where leaks are filtered out. Texts of
any length are searched whole. Repeated rows and ties are each held against each item, repeated items
too; rows of a null id have their finds under it. Empty tables give no finds. The index over the items
is sent to the tasks in blocks of about ITEMS_PER_BLOCK pieces; documents move nowhere.
"""

from __future__ import annotations

import functools
import string
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import distinct_words, mixed, read_table, rolling_hash, slices

MAX_EDIT_SHARE = 0.2
PIECE_WORDS = 24
RECALL = 0.98
WALKS = 4
LEAST_TABLES, MOST_TABLES = 12, 256
SAMPLED = 4
ITEMS_PER_BLOCK = 20_000

_SEED = 20_017
_MARK_BITS = 22
_WIDTHS = (3, 2, 1)
_PAIR_FACTOR = 0x9E3779B97F4A7C15
_EMBED_ROWS = 200_000
_TRIALS = 1000
_PUNCTUATION = string.punctuation.encode()


def _symbol(word: bytes) -> int:
    """Hash of the word without punctuation; zero if nothing is left of it."""
    bare = word.strip(_PUNCTUATION)
    return xxhash.xxh64_intdigest(bare) or 1 if bare else 0


def _sequences(texts: list[bytes]) -> list[np.ndarray]:
    """The symbols of each text's words."""
    lowered = pa.array([text.decode().lower() for text in texts], pa.large_string())
    words, order, starts = distinct_words(lowered)
    row = np.array([_symbol(word) for word in words], np.uint64)[order]
    return [own[own != 0] for own in (row[a:b] for a, b in zip(starts, starts[1:], strict=False))]


def _semi_global(item: np.ndarray, stretch: np.ndarray, anchored: bool) -> np.ndarray:
    """Edit distance of the item to the stretch's parts that end at each place.

    The parts may begin anywhere, or at the stretch's begin if ``anchored``.
    """
    places = np.arange(len(stretch) + 1)
    row = places.copy() if anchored else np.zeros(len(places), np.int64)
    for number, word in enumerate(item, 1):
        above = np.empty_like(row)
        above[0] = number
        above[1:] = np.minimum(row[:-1] + (stretch != word), row[1:] + 1)
        row = np.minimum.accumulate(above - places) + places
    return row


def _keys(row: np.ndarray, starts: np.ndarray, length: int, tables: int) -> np.ndarray:
    """Keys of the windows of ``length`` words, one row for each table; a table samples one walk."""
    draw = np.random.default_rng([_SEED, length])
    steps, padded = 2 * length, np.append(row, np.zeros(length + 1, np.uint64))
    turns = draw.integers(1, 1 << 63, (steps, WALKS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sampled: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for table in range(tables):
        for step in draw.choice(steps, min(SAMPLED, steps), replace=False).tolist():
            sampled[step].append((table, table % WALKS))
    keys = np.zeros((tables, len(starts)), np.uint64)
    pointer = np.zeros((WALKS, len(starts)), np.int64)
    with np.errstate(over="ignore"):
        for step in range(1 + max(sampled)):
            word = np.where(pointer < length, padded[starts + pointer], np.uint64(0))
            for table, walk in sampled[step]:
                keys[table] = (keys[table] + word[walk] + np.uint64(step)) * np.uint64(_PAIR_FACTOR)
            pointer += (mixed(word * turns[step]) >> np.uint64(63)).astype(np.int64)
    return keys


@functools.cache
def tables_for(length: int, edits: int, recall: float = RECALL) -> int:
    """Tables that find a piece of ``length`` words with ``edits`` edits in the stated part of trials."""
    draw = np.random.default_rng([_SEED, length, edits])
    pieces = draw.integers(1, 1 << 63, (_TRIALS, length), dtype=np.uint64)
    # As in a text: other words around, and windows that begin up to the edits before or behind.
    size = length + 3 * edits
    around = draw.integers(1, 1 << 63, (_TRIALS, size + edits), dtype=np.uint64)
    rows = []
    for piece, other in zip(pieces.tolist(), around.tolist(), strict=True):
        for _ in range(edits):
            place, kind = int(draw.integers(len(piece))), int(draw.integers(3))
            piece[place : place + (kind < 2)] = [other.pop()] if kind else []
        rows.append([*other[:edits], *piece, *other[edits:]][:size])
    before = _keys(pieces.ravel(), np.arange(_TRIALS) * length, length, MOST_TABLES)
    starts = (np.arange(_TRIALS)[:, None] * size + np.arange(2 * edits + 1)).ravel()
    after = _keys(np.array(rows, np.uint64).ravel(), starts, length, MOST_TABLES)
    met = (after.reshape(MOST_TABLES, _TRIALS, -1) == before[:, :, None]).any(axis=2)
    found = np.maximum.accumulate(met, axis=0).mean(axis=1)
    if found[-1] < recall:
        raise ValueError(f"{MOST_TABLES} tables find {found[-1]:.2f} of pieces of {length} words with {edits} edits")
    needed = int(np.argmax(found >= recall)) + 1
    return max(LEAST_TABLES, -(-needed // WALKS) * WALKS)


class ItemIndex:
    """Tables over the pieces of a block of items, by piece length."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = MAX_EDIT_SHARE) -> None:
        self.share = share
        found = _sequences([(text or "").encode() for _, text in items])
        self.items = [(i, s) for (i, _), s in zip(items, found, strict=True) if len(s)]
        self.marks = {width: np.zeros(1 << _MARK_BITS, bool) for width in _WIDTHS}
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.piece_edits: dict[int, int] = defaultdict(int)
        for number, (_, sequence) in enumerate(self.items):
            pieces = -(-len(sequence) // PIECE_WORDS)
            edges = [len(sequence) * i // pieces for i in range(pieces + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                by_length[b - a].append((number, a))
                self.piece_edits[b - a] = max(self.piece_edits[b - a], self._edits(len(sequence)) // pieces)
            for width, mark in self.marks.items():
                mark[self._grams(sequence, width)] = True
        self.gap = 1 + max((self._edits(len(s)) for _, s in self.items), default=0)
        self.tables = {}
        for length, pieces in by_length.items():
            row = np.concatenate([self.items[i][1][a : a + length] for i, a in pieces])
            tables = tables_for(length, self.piece_edits[length])
            keys = _keys(row, np.arange(len(pieces)) * length, length, tables)
            order = np.argsort(keys, axis=1, kind="stable")
            self.tables[length] = np.take_along_axis(keys, order, axis=1), order, pieces

    def _edits(self, length: int) -> int:
        return int(self.share * length + 1e-9)

    def _grams(self, row: np.ndarray, width: int) -> np.ndarray:
        return rolling_hash(row, width, _PAIR_FACTOR) >> np.uint64(64 - _MARK_BITS)

    def _windows(self, row: np.ndarray, length: int, sums: dict[int, np.ndarray]) -> np.ndarray:
        """Starts of the windows that share enough words, pairs and triples with items."""
        starts = None
        for width in _WIDTHS:
            grams = length - width + 1
            needed = grams - width * self.piece_edits[length]
            if needed > 0:
                total, count = sums[width], max(0, len(row) - length + 1)
                if starts is None:
                    starts = np.flatnonzero(total[grams : grams + count] - total[:count] >= needed)
                else:
                    starts = starts[total[starts + grams] - total[starts] >= needed]
        return np.arange(max(0, len(row) - length + 1)) if starts is None else starts

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, first word, word after the last, edits) of each find in the texts."""
        sequences = _sequences(texts)
        pad = np.zeros(self.gap, np.uint64)
        row = np.concatenate([x for s in sequences for x in (s, pad)]) if sequences else pad
        begins = np.cumsum([0, *(len(s) + self.gap for s in sequences)])
        sums = {w: np.concatenate([[0], np.cumsum(m[self._grams(row, w)])]) for w, m in self.marks.items()}
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for length, (keys, order, pieces) in self.tables.items():
            starts = self._windows(row, length, sums)
            if not len(starts):
                continue
            for part in np.array_split(starts, 1 + len(starts) // _EMBED_ROWS):
                text = np.searchsorted(begins, part, side="right") - 1
                own = _keys(row, part, length, len(keys))
                for table in range(len(own)):
                    low = np.searchsorted(keys[table], own[table], side="left")
                    high = np.searchsorted(keys[table], own[table], side="right")
                    for at in np.flatnonzero(high > low):
                        for piece in order[table, low[at] : high[at]].tolist():
                            number, offset = pieces[piece]
                            found[int(text[at]), number].add(int(part[at] - begins[text[at]]) - offset)
        for (text, number), places in found.items():
            yield from self._verified(number, sorted(places), text, sequences[text])

    def _verified(self, number: int, places: list[int], text: int, words: np.ndarray):
        """Finds around the places where the item may begin, give or take its edits and a piece's."""
        item_id, item = self.items[number]
        length, edits = len(item), self._edits(len(item))
        apart = length + 4 * edits
        edges = [0, *(i for i in range(1, len(places)) if places[i] - places[i - 1] > apart), len(places)]
        for a, b in zip(edges, edges[1:], strict=False):
            first = max(0, places[a] - 2 * edits)
            stretch = words[first : max(0, places[b - 1] + length + 2 * edits)]
            for begin, end, away in self._cut(item, stretch, edits):
                yield text, item_id, first + begin, first + end, away

    @staticmethod
    def _cut(item: np.ndarray, stretch: np.ndarray, edits: int) -> list[tuple[int, int, int]]:
        """(begin, end, edits) of finds that do not overlap: the nearest first, then what is left beside them."""
        ends = _semi_global(item, stretch, anchored=False)
        least, finds = max(1, len(item) - edits), []
        near = np.flatnonzero(ends <= edits)
        for end in near[np.argsort(ends[near], kind="stable")].tolist():
            at = bisect(finds, (end,))
            low = max(finds[at - 1][1] if at else 0, end - len(item) - edits)
            if end - low < least:
                continue
            back = _semi_global(item[::-1], stretch[low:end][::-1], anchored=True)
            size = int(back.argmin())
            if size and back[size] <= edits:
                finds.insert(at, (end - size, end, int(back[size])))
        return finds


def _blocks(benchmark: DataFrame, share: float) -> Iterator:
    """Broadcast indexes over the items, block by block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = F.floor(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")) / PIECE_WORDS) + 1
    blocks = 1 + (items.agg(F.sum(pieces)).first()[0] or 0) // ITEMS_PER_BLOCK
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        listed = sorted({(r.item_id, r.text) for r in own.collect()}, key=lambda r: (r[0] is None, r[0], r[1] or ""))
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex(listed, share))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MAX_EDIT_SHARE) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, edits) of every item found in a row of ``docs``.

    Words count from 0 within the document; finds of one item that overlap are one, the nearest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, last_word long, edits long"

    def finder(sent):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            for batch, texts in slices(batches):
                ids = batch.column(0).to_pylist()
                made = [(ids[t], item, a, b - 1, edits) for t, item, a, b, edits in sent.value.matches(texts)]
                columns = zip(*made, strict=True) if made else [[]] * 5
                names = ["doc_id", "item_id", "first_word", "last_word", "edits"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        return found

    parts = [rows.mapInArrow(finder(sent), schema) for sent in _blocks(benchmark, share)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MAX_EDIT_SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found."""
    for sent in _blocks(benchmark, share):
        docs = docs.where(~F.pandas_udf(_leaking(sent), "boolean")(F.col("text").cast("string")))
    return docs


def _leaking(sent):
    def leaking(texts: pd.Series) -> pd.Series:
        found = np.zeros(len(texts), bool)
        rows = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string(), from_pandas=True)})
        at = 0
        for part, own in slices([rows]):
            found[[at + t for t, *_ in sent.value.matches(own)]] = True
            at += part.num_rows
        return pd.Series(found)

    return leaking


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
