"""Byte-pair vocabularies of the tokenizers library's files, and ids of text pieces."""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex

from gradeworks.llm.common import Memo, flat


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others, in order, take the letters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    """Ids by token, merges as (left id, right id) -> (rank, id), added tokens by content."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    added: dict[str, int]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        letters = byte_letters()
        table = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in self.ids.items():
            table[i] = bytes(letters[c] for c in token)
        for content, i in self.added.items():
            table[i] = content.encode()
        return table


@functools.cache
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    model = stored["model"]
    ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[ids[left], ids[right]] = (rank, ids[left + right])
    assert not suffix or any(token.endswith(suffix) for token in ids)
    return Vocabulary(ids, merges, {t["content"]: t["id"] for t in stored["added_tokens"]})


# Fixed by the file of the vocabulary with word ends: how a text is cut into pre-tokens.
_WORD_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


class WordCutter:
    """Cuts text as the vocabulary with word ends asks for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        longest_first = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        self.added = vocabulary.added
        self.pre_token = regex.compile(_WORD_PRE_TOKEN)

    def __call__(self, text: str) -> list[str]:
        """Normalised pre-tokens; strings of special tokens stand for themselves."""
        if text.isascii() and "|" not in text:
            low = text.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,:;!?":
                return [low[:-1], low[-1]]
            return self.pre_token.findall(low)
        parts = self.special.split(text) if self.added else [text]
        # The library lower-cases letter by letter, so a final sigma is like any other.
        plain = [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts]
        return [
            word
            for part, low in zip(parts, plain, strict=True)
            for word in ([part] if part in self.added else self.pre_token.findall(low))
        ]


WORD_END = "</w>"
# Pre-tokens given to the library at once.
_WORDS = 1000


class LibraryWords:
    """The tokenizers library's ids of pre-tokens, many at a time.

    The pre-tokens go in as one text. The last token of a pre-token, and no other, is one that
    ends a word, which tells the pre-tokens apart again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = load_vocabulary(path)
        self.last = np.zeros(1 + max([*vocabulary.ids.values(), *vocabulary.added.values()]), bool)
        self.last[[i for token, i in vocabulary.ids.items() if token.endswith(WORD_END)]] = True
        self.last[list(vocabulary.added.values())] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and the number of ids of each."""
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for start in range(0, len(words), _WORDS):
            own = words[start : start + _WORDS]
            ids = self._ids(" ".join(own))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own):
                parts.append((ids, np.diff(ends, prepend=0)))
            else:  # a letter the library cuts in another way
                each = [self._ids(word) for word in own]
                parts.append((np.concatenate(each), np.array([len(x) for x in each])))
        ids, counts = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(counts)


def is_plain(text: str) -> bool:
    """Whether all letters are such that cutting and lower-casing agree with the library's, and stay as they are.

    That holds in the Latin blocks, where nothing composes. Elsewhere normal forms and letter tables of
    Python and the library may differ, and a normalised piece may change when it is normalised again.
    """
    return text.isascii() or (max(text) < LATIN_END and DOTTED_I not in text)


# The first code point behind the Latin blocks, and the one letter in them that lower-cases to two.
LATIN_END, DOTTED_I = "\u0250", "\u0130"


class LibraryChunks:
    """The library's ids of stretches without ASCII white space, which it encodes one by one.

    Plain stretches are cut here and their distinct pre-tokens are encoded in bulk; any other goes to
    the library whole.
    """

    def __init__(self, path: str) -> None:
        self.words = LibraryWords(path)
        self.table = PieceTable(self.words.encode)
        self.cut = WordCutter(load_vocabulary(path))

    def whole(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.words.library.encode_batch(chunks, add_special_tokens=False)]

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and the number of ids of each."""
        pieces: list[list[str]] = []
        odd: list[int] = []
        for chunk in chunks:
            if chunk.isalpha():  # ASCII letters alone are one pre-token
                pieces.append([chunk.lower().decode()])
                continue
            text = chunk.decode()
            if not is_plain(text):
                odd.append(len(pieces))
            pieces.append(self.cut(text) if is_plain(text) else [])
        flat_pieces, starts = flat(pieces)
        ids, counts = self.table.look_up(flat_pieces)
        counts = np.diff(np.concatenate([[0], np.cumsum(counts)])[starts])
        if odd:
            made = self.whole([chunks[i].decode() for i in odd])
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in zip(odd, made, strict=True):
                rows[i] = np.array(own, ids.dtype)
            ids, counts = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return ids, counts


class PieceTable:
    """Ids of pieces of text, each worked out once while the table holds it.

    ``encode`` gets all pieces a slice has that are new, and returns their ids in a row and
    the number of ids of each.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.index = Memo(self._noted)
        self.new: list = []
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _noted(self, piece) -> int:
        self.new.append(piece)
        return len(self.index)

    def look_up(self, pieces: list, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and the number of ids of each piece.

        ``order`` tells which of the pieces stands at each place, if not one after the other.
        """
        before = len(self.index)
        self.index.clear_if_full()
        if len(self.index) < before:
            self._empty()
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            made, sizes = self.encode(self.new)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, made.astype(np.uint32)])
            self.new = []
        at = at if order is None else at[order]
        counts = self.starts[at + 1] - self.starts[at]
        shift = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts)
        return self.ids[shift + np.arange(len(shift))], counts
