"""Token counts by the whole-token shortcut, for a vocabulary with word ends.

Before any text is read, every vocabulary string that can end a word is merged from its
bytes; those that come out as one token, and that cutting leaves in one piece, are proven whole. A pre-token found among them
counts one without a merge; only the rest goes through the library's merges, many distinct
pre-tokens at a time. The counts are those of the library without begin, end or other tokens
it would add; strings of special tokens inside a text count one, as by its default.

Stretches with letters outside the Latin blocks go to the library whole.

Null and empty texts have no tokens; texts of any length are counted whole. Repeated rows are
counted each, rows of a null id too. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import MEMO_ENTRIES, Memo, flat, read_table, slices
from gradeworks.llm.vocabulary import (
    WORD_END,
    LibraryChunks,
    Vocabulary,
    WordCutter,
    byte_letters,
    is_plain,
    load_vocabulary,
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048


def merge_count(word: bytes, vocabulary: Vocabulary) -> int:
    """Tokens of one pre-token: the lowest rank among the neighbours is merged until none is left."""
    letters = _letters()
    text = [letters[b] for b in word]
    symbols = [vocabulary.ids[c] for c in text[:-1]] + [vocabulary.ids[text[-1] + WORD_END]]
    merges = vocabulary.merges
    while len(symbols) > 1:
        found = [(merges[pair][0], i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in merges]
        if not found:
            break
        rank, first = min(found)
        made = merges[symbols[first], symbols[first + 1]][1]
        at, merged = 0, []
        while at < len(symbols):
            if at + 1 < len(symbols) and merges.get((symbols[at], symbols[at + 1]), (-1,))[0] == rank:
                merged.append(made)
                at += 2
            else:
                merged.append(symbols[at])
                at += 1
        symbols = merged
    return len(symbols)


def _letters() -> dict[int, str]:
    return {b: c for c, b in byte_letters().items()}


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens that are proven to encode alone as one token."""
    vocabulary, letters = load_vocabulary(path), byte_letters()
    ends = [t.removesuffix(WORD_END) for t in vocabulary.ids if t.endswith(WORD_END)]
    words = [bytes(letters[c] for c in word) for word in ends if word]
    proven = [_strict(word) for word in words if merge_count(word, vocabulary) == 1]
    cut = WordCutter(vocabulary)
    return frozenset(word for word in proven if word and is_plain(word) and cut(word) == [word])


def _strict(word: bytes) -> str | None:
    """The string of the bytes; none where they begin or end inside a letter."""
    try:
        return word.decode()
    except UnicodeDecodeError:
        return None


class ChunkCounts:
    """Tokens of stretches without ASCII white space, which this vocabulary encodes one by one."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        vocabulary = load_vocabulary(path)
        self.whole = whole | vocabulary.added.keys()
        self.library = LibraryChunks(path)
        self.cut, self.merge = self.library.cut, self.library.words.encode
        self.forget()

    def forget(self) -> None:
        self.numbers = Memo(lambda _: len(self.numbers))
        self.counts = np.zeros(0, np.int64)
        self.merged: dict[str, int] = {}

    def look_up(self, chunks: list[bytes]) -> np.ndarray:
        """Number of tokens of each chunk."""
        if len(self.numbers) > MEMO_ENTRIES:
            self.forget()
        known = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        new = list(itertools.islice(self.numbers, known, None))
        texts = [chunk.decode() for chunk in new]
        plain = [is_plain(text) for text in texts]
        words, starts = flat([self.cut(t) if own else [] for t, own in zip(texts, plain, strict=True)])
        rest = sorted({w for w in words if w not in self.whole and w not in self.merged})
        self.merged.update(zip(rest, self.merge(rest)[1].tolist(), strict=True))
        each = [1 if w in self.whole else self.merged[w] for w in words]
        sums = np.diff(np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[starts])
        odd = [i for i, own in enumerate(plain) if not own]
        if odd:
            sums[odd] = [len(ids) for ids in self.library.whole([texts[i] for i in odd])]
        self.counts = np.concatenate([self.counts, sums])
        return self.counts[at]


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``; no rows move between tasks."""
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounts(path, proven.value)
        for batch, texts in slices(batches):
            chunks, ends = flat([text.split() for text in texts])
            totals = np.concatenate([[0], np.cumsum(counter.look_up(chunks))])
            sizes = pa.array([len(text) for text in texts], pa.int64())
            tokens = pa.array(totals[ends[1:]] - totals[ends[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, and whether they exceed TOKEN_LIMIT tokens."""
    counts = count_tokens(read_table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
