"""LM scoring by logistic mixing of hashed-context bit predictors.

A text is its words, ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, each closed by a blank,
then one end mark. Its bytes are predicted bit by bit, highest bit first. A context and the bits
of the byte known so far lead to a slot with counts of zeros and ones, which give a prediction:

* a word's first byte is predicted after the word before it (hashed to a class of its kind),
  after that word's kind, and from nothing;
* any other byte after the last 1, 2 and 3 bytes of its word and after all of the word so far.

Predictions are combined in the logistic domain by weights that a gate selects (place in the
word, bit, how often the longest context was seen) and refined by an adaptive probability map.

What is gathered grows with the corpus. All counts cover all training documents; they come from
the distinct words, which are summed by shuffles. Contexts of up to 3 bytes and the word classes
have tables whose size follows their counted number, up to MOST_SLOT_BITS and MOST_CLASS_BITS, as
there are only so many of them; these tables go to every task. Whole words so far have no bound
and are never in one place: words that share their first KEY_BYTES bytes meet in a task, which
counts their prefixes exactly. A key of more than GROUP_WORDS words is dealt by more of its bytes.
Prefixes shorter than what a group's words share are those of words in other groups as well; they
are counted over all words, and each group is given the counts after its own. So a word's counts are
those of all training documents, whatever group it is in. Each distinct word is costed once, in its
group, and texts look up the costs: those of the HEAD_WORDS most frequent words are sent to the
tasks, the others are joined.

Weights and map are learned online, chunk of words after chunk, from every distinct word of the
training documents, each left out of the counts that predict it and weighing as the root of its
count. A first pass over all of them starts every group alike and averages what the groups have
learned; in the second pass a group starts from that average, costs a chunk, then learns from it.
Words of held-out documents only are costed and not learned from. Nothing depends on the number of
tasks.

The base score is that of single words with one added to each count.

Null texts are empty and consist of the end mark; texts of any length are taken whole, in slices.
Every row is scored, ties and repeated rows alike, null ids too (they belong to fold 0). Without
training documents all counts are zero. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import MEMO_ENTRIES, Memo, distinct_words, gathered, id_bucket, mixed, read_table, slices
from gradeworks.session import new_table_path

FOLDS, HELD_OUT = 7, 2
HEAD_WORDS = 200_000
KEY_BYTES = 4
GROUP_WORDS = 1 << 15
# One word in so many is learned from: all of them.
LEARN_SHARE = 1
LEAST_CLASS_BITS, MOST_CLASS_BITS = 6, 14
LEAST_SLOT_BITS, MOST_SLOT_BITS = 16, 24
ORDERS = 3

END = b"\n"
KINDS = 4
PLACES = 6
SEEN = 5
RATE = 0.3
CHUNK = 2048
LEARN_CHUNK = 256
FIRST_STEPS = 4
_GRID = np.linspace(-8, 8, 33).astype(np.float32)
_NODES = mixed(np.arange(256, dtype=np.uint64))
_BLOCK_BITS = 12
# Rows handled at once when contexts are counted: each takes some 1.5 kB meanwhile.
_PAIR_ROWS = 25_000
_SCALE = 16.0


def _kind(word: bytes) -> int:
    """Kind of a word for what follows it; 0 is the begin of a text."""
    return 1 if word[-1:] in b".!?" else 2 if len(word) <= 3 else 3


class WordIndex:
    """Numbers the words met so far."""

    def __init__(self, class_bits: int) -> None:
        self.class_bits = class_bits
        self.forget()

    def forget(self) -> None:
        self.words: list[bytes] = []
        self.hashes = np.empty(0, np.uint64)
        self.first = self.classes = np.empty(0, np.int64)
        self.numbers = Memo(self._add)

    def _add(self, word: bytes) -> int:
        self.words.append(word)
        return len(self.words) - 1

    @property
    def full(self) -> bool:
        return len(self.words) > MEMO_ENTRIES

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all tokens of the texts in a row, where each text starts, and the class before each token."""
        # Lower-cased before any cast: Arrow lower-cases a cast part of an array wrongly.
        words, order, starts = distinct_words(pc.ascii_lower(texts.fill_null("")))
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))[order]
        numbers = np.insert(numbers, starts[1:], self.numbers[END])
        new = self.words[len(self.hashes) :]
        made = np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)
        self.hashes = np.concatenate([self.hashes, made])
        kinds = np.fromiter(map(_kind, new), np.int64, len(new))
        self.first = np.concatenate([self.first, np.fromiter(((w or b" ")[0] for w in new), np.int64, len(new))])
        # Class 0 is that of the begin of a text; a class holds words of one kind.
        classes = (mixed(made) % np.uint64((1 << self.class_bits) // KINDS)).astype(np.int64)
        self.classes = np.concatenate([self.classes, classes * KINDS + kinds])
        starts = starts + np.arange(len(starts))
        before = np.zeros(len(numbers), np.int64)
        before[1:] = self.classes[numbers[:-1]]
        before[starts[:-1]] = 0
        return numbers, starts, before


def count_tokens(docs: DataFrame, trains: Column, class_bits: int) -> DataFrame:
    """(hash, word, n): occurrences in training documents of every word of all documents.

    Rows without a word count first bytes after a word's class; ``hash`` is then class and byte in one number.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = WordIndex(class_bits), np.zeros(0, np.int64)
        pairs = np.zeros(256 << class_bits, np.int32)

        def rows() -> pa.RecordBatch:
            columns = [index.hashes.view(np.int64), pa.array(index.words, pa.binary()), sums]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "word", "n"])

        for batch, _ in slices(batches):
            numbers, starts, before = index.tokens(batch.column(0))
            learned = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(starts))
            sums = np.concatenate([sums, np.zeros(len(index.words) - len(sums), np.int64)])
            sums += np.bincount(numbers[learned], minlength=len(sums))
            cells, found = np.unique((before * 256 + index.first[numbers])[learned], return_counts=True)
            pairs[cells] += found.astype(np.int32)
            if index.full:
                yield rows()
                index.forget()
                sums = np.zeros(0, np.int64)
        yield rows()
        cells = np.flatnonzero(pairs)
        columns = [cells, pa.nulls(len(cells), pa.binary()), pairs[cells].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "word", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"), trains.alias("trains"))
    parts = texts.mapInArrow(counted, "hash long, word binary, n long")
    return parts.groupBy("hash", "word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Places:
    """The bytes of words behind their first: word, place, byte, last bytes, and hash of the word so far."""

    owner: np.ndarray
    place: np.ndarray
    byte: np.ndarray
    recent: list[np.ndarray]
    prefix: np.ndarray


def places_of(words: list[bytes]) -> Places:
    """All predicted bytes of the words, the closing blank included; the end mark has none."""
    return _places([w + b" " if w != END else w for w in words])


def _places(closed: list[bytes]) -> Places:
    data = np.frombuffer(b"".join(closed), np.uint8)
    sizes = np.array([len(w) for w in closed], np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(closed)), sizes)
    place = np.arange(len(data)) - begins[owner]
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(data + place.astype(np.uint64) * np.uint64(256)), out=sums[1:])
        prefix = sums[:-1] - sums[begins[owner]]
    own = np.flatnonzero(place)
    recent, past = [], np.zeros(len(own), np.uint64)
    for back in range(1, ORDERS + 1):
        letter = np.where(place[own] >= back, data[np.maximum(own - back, 0)], 0).astype(np.uint64)
        past = past + (letter << np.uint64(8 * (back - 1)))
        recent.append(past + np.uint64(back << 60))
    return Places(owner[own], place[own], data[own].astype(np.int64), recent, prefix[own])


def _slot(context: np.ndarray, byte: np.ndarray, bit: int, bits: int) -> np.ndarray:
    """Slot of a context and the bits of a byte in front of ``bit``."""
    with np.errstate(over="ignore"):
        made = mixed(context + _NODES[(1 << bit) | (byte >> (8 - bit))])
    return (made >> np.uint64(64 - bits)).astype(np.int64)


def _bit(byte: np.ndarray, bit: int) -> np.ndarray:
    return (byte >> (7 - bit)) & 1


def context_pairs(words: DataFrame) -> DataFrame:
    """(context, byte, n): how often a byte follows each context of at most ORDERS bytes in the training words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, _PAIR_ROWS):
            found = places_of(part.column(0).to_pylist())
            weights = part.column(1).to_numpy().astype(float)[found.owner]
            for context in found.recent:
                keys, names = np.unique(context << np.uint64(8) | found.byte.astype(np.uint64), return_inverse=True)
                n = np.bincount(names, weights, len(keys)).astype(np.int64)
                # The order, above the 24 bits of a context's bytes, goes in a column of its own.
                order = np.full(len(keys), context[0] >> np.uint64(60) if len(context) else 0).astype(np.int32)
                columns = [order, keys.view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bytes", "key", "n"])

    parts = words.where("n > 0").select("word", "n").mapInArrow(counted, "bytes int, key long, n long")
    return parts.groupBy("bytes", "key").agg(F.sum("n").alias("n"))


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def _seen(total: np.ndarray) -> np.ndarray:
    """How often a context was seen: never, once, up to 4, up to 32 times, or more."""
    return (total > 0.5).astype(np.int64) + (total > 1.5) + (total > 4.5) + (total > 32.5)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def slot_table(pairs: DataFrame) -> np.ndarray:
    """Predictions of the contexts' slots, in sixteenths; the table has a few slots for each counted pair."""
    bits = min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, (8 * pairs.count()).bit_length()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, _PAIR_ROWS):
            order, key, n = (part.column(i).to_numpy() for i in range(3))
            context = (key.view(np.uint64) >> np.uint64(8)) + (order.astype(np.uint64) << np.uint64(60))
            byte = key & 255
            slots = np.concatenate([_slot(context, byte, bit, bits) for bit in range(8)])
            ones = np.concatenate([n * _bit(byte, bit) for bit in range(8)]).astype(float)
            seen, names = np.unique(slots, return_inverse=True)
            ones = np.bincount(names, ones, len(seen)).astype(np.int64)
            zeros = np.bincount(names, np.tile(n, 8).astype(float), len(seen)).astype(np.int64) - ones
            columns = [seen, zeros, ones]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "zeros", "ones"])

    def packed(table: pa.Table) -> pa.Table:
        slot, zeros, ones = (table[c].to_numpy() for c in ("slot", "zeros", "ones"))
        block = np.zeros(1 << _BLOCK_BITS, np.int8)
        block[slot & ((1 << _BLOCK_BITS) - 1)] = np.clip(np.rint(_stretch(zeros, ones) * _SCALE), -127, 127)
        return pa.table({"block": [int(slot[0]) >> _BLOCK_BITS], "values": pa.array([block.tobytes()], pa.binary())})

    slots = pairs.select("bytes", "key", "n").mapInArrow(counted, "slot long, zeros long, ones long")
    slots = slots.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    blocks = slots.groupBy(F.shiftright("slot", _BLOCK_BITS).alias("block")).applyInArrow(
        packed, "block long, values binary"
    )
    whole = np.zeros(1 << bits, np.int8)
    for row in blocks.collect():  # at most 1 << MOST_SLOT_BITS bytes in all
        start = row.block << _BLOCK_BITS
        whole[start : start + (1 << _BLOCK_BITS)] = np.frombuffer(row["values"], np.int8)
    return whole


@dataclass
class Mixer:
    """Gated weights and the map over the mix: of each set, and of each row of cells."""

    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def start(cls, sets: int, inputs: int, rows: int) -> Mixer:
        weights = np.full((sets, inputs), np.float32(1.2 / inputs), np.float32)
        return cls(weights, np.tile(_squash(_GRID), (rows, 1)).astype(np.float32))

    def copy(self) -> Mixer:
        return Mixer(self.weights.copy(), self.refined.copy())

    def _mixed(self, inputs: list[np.ndarray], sets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(sets), np.float32)
        for i, x in enumerate(inputs):
            total += x * self.weights[sets, i]
        return total

    @staticmethod
    def _cell(mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = (np.clip(mix, _GRID[0], _GRID[-1] - np.float32(1e-5)) - _GRID[0]) * np.float32(2)
        low = scaled.astype(np.int64)
        return low, scaled - low

    def predict(self, inputs: list[np.ndarray], sets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probability that the bit is one."""
        mix = self._mixed(inputs, sets)
        low, part = self._cell(mix)
        at = rows * len(_GRID) + low
        flat = self.refined.ravel()
        refined = flat[at] * (1 - part) + flat[at + 1] * part
        return np.clip((_squash(mix) + refined) / 2, np.float32(1e-6), np.float32(1 - 1e-6))

    def learn(self, inputs: list, sets: np.ndarray, rows: np.ndarray, bits: np.ndarray, times: np.ndarray) -> None:
        """One step on bits that stand for ``times`` each."""
        mix = self._mixed(inputs, sets)
        error = (bits - _squash(mix)) * times
        count = len(self.weights)
        each = np.bincount(sets, times, count) + 20
        for i, x in enumerate(inputs):
            self.weights[:, i] += RATE * np.bincount(sets, error * x, count) / each
        low, part = self._cell(mix)
        cells = np.concatenate([rows * len(_GRID) + low, rows * len(_GRID) + low + 1])
        shares = np.concatenate([(1 - part) * times, part * times])
        wanted = np.bincount(cells, shares * np.tile(bits, 2), self.refined.size)
        weight = np.bincount(cells, shares, self.refined.size)
        flat = self.refined.ravel()
        flat += ((wanted - weight * flat) / (weight + 200)).astype(np.float32)


WORD_INPUTS = ORDERS + 1
WORD_SETS = PLACES * 8 * SEEN


class PrefixCounts:
    """Zeros and ones after the prefixes of a group's words, in a table with slots for all of them.

    Prefixes of a word from its depth on are those of this group alone and counted here. The counts
    after shorter ones, as ``stem_counts`` has them, are given.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, depths: np.ndarray, stems: pa.Table) -> None:
        known = np.flatnonzero(counts)
        found = places_of([words[i] for i in known.tolist()])
        own = np.flatnonzero(found.place >= depths[known][found.owner])
        after = stems["after"].combine_chunks()
        shared = stems["prefix"].to_numpy().view(np.uint64)[pc.list_parent_indices(after).to_numpy()]
        of_byte, of_n = (x.to_numpy() for x in after.flatten().flatten())
        self.bits = max(8, (8 * max(len(found.byte), len(own) + len(shared))).bit_length())
        self.zeros, self.ones = np.zeros((2, 1 << self.bits), np.float32)
        prefix = np.concatenate([found.prefix[own], shared])
        byte = np.concatenate([found.byte[own], of_byte.astype(np.int64)])
        n = np.concatenate([counts[known][found.owner[own]], of_n]).astype(np.float32)
        for bit in range(8):
            slot = _slot(prefix, byte, bit, self.bits)
            ones = _bit(byte, bit) == 1
            np.add.at(self.ones, slot[ones], n[ones])
            np.add.at(self.zeros, slot[~ones], n[~ones])


class GroupModel:
    """The words of one group under the shared slots, the counts after their prefixes and a mixer."""

    def __init__(self, slots: np.ndarray, table: pa.Table, stems: pa.Table, mixer: Mixer) -> None:
        self.slots, self.slot_bits = slots, len(slots).bit_length() - 1
        self.words, self.counts, self.mixer = table["word"].to_pylist(), table["n"].to_numpy(), mixer
        self.prefixes = PrefixCounts(self.words, self.counts, table["depth"].to_numpy(), stems)

    def bits(self, chosen: np.ndarray) -> tuple[Places, list[tuple]]:
        """Bytes of the chosen words behind their first; of each bit: shared inputs, counts after the prefix, bits."""
        found = places_of([self.words[i] for i in chosen.tolist()])
        table, size, of_bits = self.prefixes, self.prefixes.bits, []
        for bit in range(8):
            shared = [self.slots[_slot(c, found.byte, bit, self.slot_bits)] / np.float32(_SCALE) for c in found.recent]
            slot = _slot(found.prefix, found.byte, bit, size)
            of_bits.append((shared, table.zeros[slot], table.ones[slot], _bit(found.byte, bit)))
        return found, of_bits

    @staticmethod
    def _gated(place: np.ndarray, bit: int, shared: list, zeros: np.ndarray, ones: np.ndarray) -> tuple:
        seen = _seen(zeros + ones)
        sets = (np.minimum(place - 1, PLACES - 1) * 8 + bit) * SEEN + seen
        return [*shared, _stretch(zeros, ones)], sets, seen

    def costs(self, chosen: np.ndarray, found: Places, of_bits: list[tuple]) -> np.ndarray:
        """log10 of the probability of the chosen words' bytes behind their first."""
        total = np.zeros(len(chosen))
        for bit, (shared, zeros, ones, value) in enumerate(of_bits):
            p = self.mixer.predict(*self._gated(found.place, bit, shared, zeros, ones))
            total += np.bincount(found.owner, np.log10(np.where(value == 1, p, 1 - p)), len(chosen))
        return total

    def learn(self, chosen: np.ndarray, found: Places, of_bits: list[tuple]) -> None:
        """One step on those of the chosen words that occur in training, each without one occurrence of its own."""
        known = np.flatnonzero(self.counts[chosen][found.owner])
        place = found.place[known]
        times = np.sqrt(self.counts[chosen])[found.owner[known]].astype(np.float32)
        for bit, (shared, zeros, ones, value) in enumerate(of_bits):
            value = value[known]
            zeros, ones = np.maximum(zeros[known] - (value == 0), 0), np.maximum(ones[known] - (value == 1), 0)
            self.mixer.learn(*self._gated(place, bit, [x[known] for x in shared], zeros, ones), value, times)

    def chunks(self, size: int = CHUNK) -> Iterator[np.ndarray]:
        """Words in an order of their own, ``size`` at a time."""
        draw = np.array([xxhash.xxh64_intdigest(w, 7) for w in self.words], np.uint64)
        order = np.argsort(draw, kind="stable")
        for start in range(0, len(order), size):
            yield order[start : start + size]


def grouped_words(words: DataFrame) -> DataFrame:
    """The words with what they are dealt by: their first bytes, the key, and for large keys a piece, the bytes behind.

    ``depth`` bytes count, KEY_BYTES or, while more than GROUP_WORDS words share them, twice as many.
    """
    depth = KEY_BYTES
    keyed = words.withColumns({
        "key": F.substring("word", 1, depth), "piece": F.substring("word", 1, 0), "depth": F.lit(depth),
    })
    while True:
        sizes = keyed.groupBy("key", "piece").agg(F.count("*").alias("size"))
        large = sizes.where(F.col("size") > GROUP_WORDS).select("key", "piece", F.lit(True).alias("large"))
        count = large.limit(HEAD_WORDS + 1).count()
        if not count:
            return keyed.select("hash", "word", "n", "key", "piece", "depth")
        depth *= 2
        keyed = keyed.join(F.broadcast(large) if count <= HEAD_WORDS else large, ["key", "piece"], "left")
        longer = F.substring("word", KEY_BYTES + 1, depth - KEY_BYTES)
        keyed = keyed.withColumns({
            "piece": F.when(F.col("large"), longer).otherwise(F.col("piece")),
            "depth": F.when(F.col("large"), depth).otherwise(F.col("depth")),
        }).drop("large")


def stem_counts(dealt: DataFrame) -> DataFrame:
    """(group, prefix, after): of each prefix shorter than its words' depth, by group, the bytes behind it in all training words."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, _PAIR_ROWS):
            found = _places(part.column(1).to_pylist())
            group, n = (part.column(i).to_numpy()[found.owner] for i in (0, 2))
            columns = [group, found.prefix.view(np.int64), found.byte.astype(np.int16), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["group", "prefix", "byte", "n"])

    closed = F.concat("word", F.lit(b" "))
    stems = dealt.where(F.col("word") != F.lit(END)).groupBy("group", F.substring(closed, F.lit(1), F.col("depth")).alias("stem"))
    stems = stems.agg(F.sum("n").alias("n")).mapInArrow(places, "group long, prefix long, byte short, n long")
    path = new_table_path(dealt.sparkSession, "word-stems")
    stems.groupBy("group", "prefix", "byte").agg(F.sum("n").alias("n")).write.parquet(path)
    stems = dealt.sparkSession.read.parquet(path)
    after = stems.where("n > 0").groupBy("prefix", "byte").agg(F.sum("n").alias("n"))
    after = after.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("byte", "n"))).alias("after"))
    return stems.select("group", "prefix").distinct().join(after, "prefix").select("group", "prefix", "after")


def word_costs(words: DataFrame, total: int, slots: np.ndarray) -> DataFrame:
    """(hash, n, cost) of every distinct word: learns weights and map, then costs in a second pass."""
    spark = words.sparkSession
    groups = max(1, -(-total // GROUP_WORDS))
    dealt = grouped_words(words).withColumn("group", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    path = new_table_path(spark, "stem-counts")
    stem_counts(dealt).write.parquet(path)
    both = dealt.groupBy("group").cogroup(spark.read.parquet(path).groupBy("group"))
    # The shared slots: at most 1 << MOST_SLOT_BITS bytes.
    sent = spark.sparkContext.broadcast((slots, Mixer.start(WORD_SETS, WORD_INPUTS, SEEN)))

    def model(table: pa.Table, stems: pa.Table, slots: np.ndarray, mixer: Mixer) -> GroupModel:
        return GroupModel(slots, table, stems.sort_by("prefix"), mixer.copy())

    def learned(table: pa.Table, stems: pa.Table) -> pa.Table:
        shared, first = sent.value
        group, steps = model(table.sort_by("word"), stems, shared, first), 0
        for chunk in group.chunks(LEARN_CHUNK):
            group.learn(chunk, *group.bits(chunk))
            steps += int((group.counts[chunk] > 0).sum())
        own = np.concatenate([group.mixer.weights, group.mixer.refined], axis=None).astype(np.float64)
        return pa.table({"cell": np.arange(len(own) + 1), "s": np.append(steps * own, steps)})

    mixer = _average(both.applyInArrow(learned, "cell long, s double"), sent.value[1])
    second = spark.sparkContext.broadcast((slots, mixer))

    def costed(table: pa.Table, stems: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        group = model(table, stems, *second.value)
        costs = np.zeros(len(group.words))
        for chunk in group.chunks():
            found = group.bits(chunk)
            costs[chunk] = group.costs(chunk, *found)
            group.learn(chunk, *found)
        return pa.table({"hash": table["hash"], "n": table["n"], "cost": costs})

    return both.applyInArrow(costed, "hash long, n long, cost double")


def _average(parts: DataFrame, start: Mixer) -> Mixer:
    """Mean of the groups' weights and maps by their steps, from every group's cells times its steps, and the steps.

    They are added up number by number in Spark: a task has one Python worker, not one more for the sums.
    """
    rows = parts.groupBy("cell").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(start.weights.size + start.refined.size + 1)
    for row in rows:
        sums[row.cell] = row.s
    if not sums[-1]:
        return start
    # Sums of doubles come in any order; far fewer digits than they agree on are used.
    mean = np.round(sums[:-1] / sums[-1], 6).astype(np.float32)
    size = start.weights.size
    return Mixer(mean[:size].reshape(start.weights.shape), mean[size:].reshape(start.refined.shape))


def first_byte_costs(pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of a first byte after each class, from their counts.

    ``pairs`` has a row for each class. Inputs are the counts after the class, after its kind, and
    of all; weights and map are learned from the counts themselves, which are as many as the
    classes allow.
    """
    classes = len(pairs)
    by_kind = pairs.reshape(-1, KINDS, 256).sum(axis=0)
    mixer = Mixer.start(8 * SEEN, 3, SEEN)

    def nodes(counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones behind each beginning of ``bit`` bits."""
        halves = counts.reshape(len(counts), 1 << bit, 2, -1).sum(axis=3)
        return halves[..., 0], halves[..., 1]

    def bit_inputs(bit: int, rows: slice, leave: np.ndarray | None = None) -> tuple:
        z, o = (x[rows].astype(np.float32).copy() for x in nodes(pairs, bit))
        if leave is not None:
            z, o = (np.maximum(x - y, 0) for x, y in zip((z, o), leave, strict=True))
        kinds = np.arange(classes)[rows] % KINDS
        inputs = [_stretch(z, o)]
        inputs.append(np.stack([_stretch(*(x.astype(np.float32) for x in nodes(by_kind, bit)))[k] for k in range(KINDS)])[kinds])
        inputs.append(np.broadcast_to(_stretch(*nodes(by_kind.sum(axis=0)[None], bit)), z.shape).astype(np.float32))
        seen = _seen(z + o)
        return [x.ravel() for x in inputs], (bit * SEEN + seen).ravel(), seen.ravel(), z.shape

    step = 256
    for start in range(0, classes, step):
        rows = slice(start, start + step)
        for bit in range(8):
            both = [x[rows] for x in nodes(pairs, bit)]
            if not any(x.any() for x in both):
                continue
            # A node's zeros and ones, each without one of its own.
            sides = []
            for value, own in enumerate(both):
                inputs, sets, seen, _ = bit_inputs(bit, rows, [(own > 0) & (value == v) for v in (0, 1)])
                met = np.flatnonzero(own.ravel())
                weight = own.ravel()[met].astype(np.float32)
                sides.append([*[x[met] for x in inputs], sets[met], seen[met], np.full(len(met), value), weight])
            *inputs, sets, seen, bits, weight = (np.concatenate(x) for x in zip(*sides, strict=True))
            for _ in range(FIRST_STEPS):
                mixer.learn(inputs, sets, seen, bits, weight)
    costs = np.zeros((classes, 256), np.float32)
    for start in range(0, classes, step):
        rows = slice(start, start + step)
        for bit in range(8):
            inputs, sets, seen, shape = bit_inputs(bit, rows)
            p = mixer.predict(inputs, sets, seen).reshape(shape)
            both = np.log10(np.stack([1 - p, p], axis=2)).reshape(shape[0], -1)
            costs[rows] += np.repeat(both, 256 // both.shape[1], axis=1)
    return costs


@dataclass(frozen=True)
class Model:
    """Costs of words and of first bytes, and the totals of the training documents."""

    words: DataFrame
    first_bytes: np.ndarray
    class_bits: int
    tokens: int
    distinct: int


def train(docs: DataFrame, trains: Column) -> Model:
    """Learns from the rows for which ``trains`` holds; words of the others are costed as well."""
    spark = docs.sparkSession
    bits = docs.count().bit_length() - 6
    class_bits = min(MOST_CLASS_BITS, max(LEAST_CLASS_BITS, bits))
    path = new_table_path(spark, "word-counts")
    count_tokens(docs, trains, class_bits).write.parquet(path)
    counts = spark.read.parquet(path)
    words = counts.where(F.length("word") > 0)
    total, tokens, distinct = words.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") > 0)).first()
    pairs = np.zeros(256 << class_bits, np.int64)
    found = counts.where("word IS NULL").select("hash", "n")
    for batch in found.toArrow().to_batches():  # as many as the classes allow
        pairs[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    contexts = new_table_path(spark, "context-pairs")
    context_pairs(words).write.parquet(contexts)
    slots = slot_table(spark.read.parquet(contexts))
    costs = new_table_path(spark, "word-costs")
    word_costs(words, total, slots).write.parquet(costs)
    first = first_byte_costs(pairs.reshape(-1, 256))
    return Model(spark.read.parquet(costs), first, class_bits, tokens or 0, distinct)


def _head(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ascending, counts and costs of the most frequent words, at most HEAD_WORDS of them."""
    step = F.floor(F.log2("n") * 8)
    sizes = words.where("n > 0").groupBy(step.alias("step")).count().collect()  # some 500 steps at most
    least, held = math.inf, 0
    for size in sorted(sizes, key=lambda r: -r["step"]):
        held += size["count"]
        if held > HEAD_WORDS:
            break
        least = size["step"]
    if least == math.inf:
        return np.empty(0, np.uint64), np.empty(0), np.empty(0)
    rows = words.where((F.col("n") > 0) & (step >= least)).toArrow()
    hashes = rows["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["n"].to_numpy()[order], rows["cost"].to_numpy()[order]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.first_bytes, *_head(model.words)))
    class_bits = model.class_bits
    names = ["row", "doc_id", "n_bytes", "n_tokens", "head_known", "head_log", "head_score", "tail"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_bytes, hashes, counts, costs = sent.value
        first_bytes, logs = first_bytes.ravel(), np.log10(counts + 1.0)
        index, row = WordIndex(class_bits), TaskContext.get().partitionId() << 33
        at, known = np.zeros(0, np.int64), np.zeros(0, bool)
        for batch, texts in slices(batches):
            if index.full:
                index.forget()
                at, known = at[:0], known[:0]
            numbers, starts, before = index.tokens(batch.column(1))
            made = index.hashes[len(known) :]
            place = np.minimum(np.searchsorted(hashes, made), max(0, len(hashes) - 1))
            at = np.concatenate([at, place])
            known = np.concatenate([known, hashes[place] == made if len(hashes) else np.zeros(len(made), bool)])
            head, place = known[numbers], at[numbers]
            own = first_bytes[before * 256 + index.first[numbers]].astype(float)
            if len(hashes):
                own += np.where(head, costs[place], 0)
                own_logs = np.where(head, logs[place], 0)
            else:
                own_logs = np.zeros(len(numbers))
            sums = [np.add.reduceat(x, starts[:-1]) for x in (head.astype(np.int64), own_logs, own)]
            ends = np.concatenate([[0], np.cumsum(~head)])[starts].astype(np.int32)
            tail = pa.array(index.hashes[numbers[~head]].view(np.int64))
            columns = [
                np.arange(row, row + len(texts)), batch.column(0), [len(t) for t in texts], np.diff(starts), *sums,
                pa.ListArray.from_arrays(pa.array(ends), tail),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = (
        "row long, doc_id long, n_bytes long, n_tokens long, head_known long, head_log double, "
        "head_score double, tail array<long>"
    )
    path = new_table_path(spark, "scores")
    texts.mapInArrow(scored, schema).write.parquet(path)
    rows = spark.read.parquet(path)
    tail = rows.select("row", F.explode("tail").alias("hash")).join(model.words, "hash")
    tail = tail.groupBy("row").agg(
        F.count_if(F.col("n") > 0).alias("tail_known"),
        F.sum(F.log10(F.col("n") + 1)).alias("tail_log"),
        F.sum("cost").alias("tail_score"),
    )
    zero = F.lit(0)
    below = math.log10(model.tokens + model.distinct + 1)
    total = F.col("head_score") + F.coalesce("tail_score", zero)
    return rows.drop("tail").join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", zero) - F.col("n_tokens") * below).alias("base_score"),
        total.alias("score"),
        (-total * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def held_out(doc_id: Column) -> Column:
    return id_bucket(doc_id, FOLDS) == HELD_OUT


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model learned from the documents outside one fold."""
    docs = read_table(spark, sf_dir, "documents")
    found = score(docs, train(docs, ~held_out(F.col("doc_id"))))
    return found.withColumn("held_out", held_out(F.col("doc_id")))
