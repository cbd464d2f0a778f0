"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens that a slice of a partition adds are laid in one row. An index maps
every mergeable pair to all its positions in the row; the active ranks are applied in
ascending order, each at all its positions from left to right, and every merge updates the
lists of the pairs it touches. A pair at many positions is merged by a few array operations,
a rarer one position by position. Pre-tokens are remembered, so a word that occurs again costs
a look-up.

Ids are those of the tokenizers library for a byte-level vocabulary without begin, end or
other added tokens; strings of special tokens inside a text become their ids. Null and empty texts
have no ids and decode to an empty text; texts of any length are encoded whole. Every row has its
result, repeated rows, ties and rows of a null id too; an empty table has none. Other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import flat, read_table, slices
from gradeworks.llm.vocabulary import PieceTable, Vocabulary, byte_letters, load_vocabulary

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Fixed by the vocabulary's file: how a text is cut into pre-tokens.
_PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


# A pair at so many positions or more is merged at all of them at once.
MANY = 32


class PairIndex:
    """Merges many pre-tokens at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.merges = vocabulary.merges
        self.first_ids = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.first_ids[byte] = vocabulary.ids[letter]
        self.rules = {rank: (*pair, made) for pair, (rank, made) in self.merges.items()}
        # Pairs as numbers; one with the end of a word (-1) is never among them.
        self.width = 2 + max(vocabulary.ids.values())
        pairs = np.array([(*pair, rank) for pair, (rank, _) in self.merges.items()], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = pairs[order, 2]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        row = np.full(1 + len(words) + sizes.sum(), -1, np.int64)  # no pair crosses the end of a word
        letters = np.ones(len(row), bool)
        letters[0] = letters[ends] = False
        row[letters] = self.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        self._merge(row)
        kept = row >= 0
        return row[kept], np.diff(np.cumsum(kept)[ends], prepend=0)

    def _merge(self, row: np.ndarray) -> None:
        """Applies all merges; -1 stands around every word, -2 for an id that is merged into its left one."""
        after = np.arange(1, len(row) + 1)
        before = np.arange(-1, len(row) - 1)
        positions: dict[int, list[int]] = {}
        active: list[int] = []

        def note(rank: int, places: list[int]) -> None:
            if rank in positions:
                positions[rank] += places
            else:
                positions[rank] = places
                heapq.heappush(active, rank)

        def note_all(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            for rank, found in self._by_rank(places, left, right):
                note(rank, found)

        # The same arrays, quicker where one number is read or written.
        ids, nexts, lasts = memoryview(row), memoryview(after), memoryview(before)
        note_all(np.arange(len(row) - 1), row[:-1], row[1:])
        while active:
            rank = heapq.heappop(active)
            left, right, made = self.rules[rank]
            found = sorted(positions.pop(rank))
            if len(found) >= MANY:
                note_all(*_merge_all(np.array(found), left, right, made, row, after, before))
                continue
            for at in found:
                other = nexts[at]
                if ids[at] != left or ids[other] != right:
                    continue
                ids[at], ids[other] = made, -2
                follow, ahead = nexts[other], lasts[at]
                nexts[at], lasts[follow] = follow, at
                if merge := self.merges.get((ids[ahead], made)):
                    note(merge[0], [ahead])
                if merge := self.merges.get((made, ids[follow])):
                    note(merge[0], [at])

    def _by_rank(self, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Ranks of the pairs that have one, each with the places of its pair."""
        keys = left * self.width + right
        found = self.keys.searchsorted(keys)
        which = (self.keys[found] == keys).nonzero()[0]
        ranks = self.ranks[found[which]]
        order = ranks.argsort()
        ranks, places = ranks[order], places[which[order]].tolist()
        starts = [*np.flatnonzero(np.diff(ranks, prepend=-1)).tolist(), len(places)]
        for rank, start, stop in zip(ranks[starts[:-1]].tolist(), starts, starts[1:], strict=False):
            yield rank, places[start:stop]


def _merge_all(
    at: np.ndarray, left: int, right: int, made: int, row: np.ndarray, after: np.ndarray, before: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges a pair at all places that still have it; the places, left and right ids of the pairs that makes."""
    other = after[at]
    stays = (row[at] == left) & (row[other] == right)
    at, other = at[stays], other[stays]
    if left == right and len(at):  # of pairs that overlap, every second from the left
        number = np.arange(len(at))
        heads = np.where(np.append(True, at[1:] != other[:-1]), number, 0)
        taken = (number - np.maximum.accumulate(heads)) % 2 == 0
        at, other = at[taken], other[taken]
    row[at], row[other] = made, -2
    follow = after[other]
    after[at], before[follow] = follow, at
    ahead = before[at]
    # Two ids made here side by side are one pair, that of the left one.
    ahead = ahead[np.append(True, ahead[1:] != at[:-1])] if len(at) else ahead
    places = np.concatenate([ahead, at])
    return places, row[places], row[after[places]]


def _pieces(path: str) -> tuple[PieceTable, regex.Pattern]:
    """Ids by pre-token, and the pattern that cuts texts; special strings are cut first."""
    vocabulary = load_vocabulary(path)
    index = PairIndex(vocabulary)
    special = vocabulary.added

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([p not in special for p in pieces])
        ids, sizes = index.encode([p.encode() for p in pieces if p not in special])
        counts = np.ones(len(pieces), np.int64)
        counts[plain] = sizes
        row = np.empty(counts.sum(), np.int64)
        owner = np.repeat(plain, counts)
        row[owner], row[~owner] = ids, [special[p] for p in pieces if p in special]
        return row, counts

    return PieceTable(encode), regex.compile(_PRE_TOKEN)


def _cut(text: str, pattern: regex.Pattern, special: list[str]) -> list[str]:
    if not any(x in text for x in special):
        return pattern.findall(text)
    parts = regex.split("(" + "|".join(regex.escape(x) for x in special) + ")", text)
    return [p for part in parts for p in ([part] if part in special else pattern.findall(part))]


def _encoder(path: str):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pattern = _pieces(path)
        special = sorted(load_vocabulary(path).added, key=len, reverse=True)
        for batch, texts in slices(batches):
            pieces, ends = flat([_cut(text.decode(), pattern, special) for text in texts])
            ids, counts = table.look_up(pieces)
            sums = np.concatenate([[0], np.cumsum(counts)])[ends]
            data = ids.astype("<u4")
            rows = [data[a:b].tobytes() for a, b in zip(sums, sums[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    return encoded


def _decoder(path: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_vocabulary(path).token_bytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                for ids in part.column(1).to_pylist():
                    found = b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
                    texts.append(found.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return decoded


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit integers."""
    return _rows(docs).mapInArrow(_encoder(path), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids); special ids become their strings."""
    schema = "doc_id long, ids binary, text string"
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), schema)


def round_trip(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``.

    Both ways run in one worker, one slice after the other.
    """
    both = lambda batches: _decoder(path)(_encoder(path)(batches))
    return _rows(docs).mapInArrow(both, "doc_id long, ids binary, text string").select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts decoded from them, as digests."""
    return round_trip(read_table(spark, sf_dir, "documents"))
