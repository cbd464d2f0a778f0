"""Substring dedup: stretches of words that occurred earlier are removed, by suffix automata.

A window is ``width`` consecutive words of a document. A window whose words also start
earlier (in a document of a smaller id, or earlier in the same one) is a repeat, and every
word that a repeat covers goes. All windows are judged on the input.

1. A document of the same text as an earlier one is a repeat altogether.
2. Every window has an anchor, the smallest hash of the ``width`` / 2 word grams in it (the last
   of equal ones), so equal windows have equal anchors at equal places. Consecutive windows
   with the same anchor form a segment. Anchors are counted over all documents; segments whose
   anchor occurs once hold no repeat and are left.
3. Segments of the same words are one content, with its first place. Any later place of the
   content is a repeat altogether.
4. What remains are windows shared by different contents of one anchor. The anchors are the
   shards: a shard's contents, earliest first, are streamed through a suffix automaton of the
   contents before. Where the longest match that ends at a word reaches ``width``, the window
   that ends there is a repeat. An anchor of more than SHARD_CONTENTS contents is cut further,
   each window becoming a shard of its own, where the first place decides.

The automata are built where their shard's contents meet and not broadcast, since here the
reference is the corpus itself and grows with it. What is broadcast are bit maps, sized by the
rows counted and bounded. They only ever tell that something is certainly not in a set; what they
let through is checked or does no harm. Words are carried by a map only while that is nearly empty,
otherwise documents meet their places in a join.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have none; texts of any length are taken
whole. Null ids come first; rows of one id and different texts are told apart and ordered by a 64-bit
hash of the text (text_key), and rows of one id and text are one document, though each has its row in
the result. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import distinct_words, flat, mixed, read_table, rolling_hash, slices
from gradeworks.session import new_table_path

WIDTH = 20
SHARD_CONTENTS = 5_000
# A bit map has MAP_SHARE to twice as many bits for each row it may be made for, and no more than two
# to the MOST_MAP_BITS, so that it can be sent. A fuller map lets more through, which costs work but no
# correct result; where what it lets through would be words, they are joined instead.
LEAST_MAP_BITS, MOST_MAP_BITS = 16, 27
MAP_SHARE = 32
_MAP_PROBES = 2
_MAP_BLOCK_BITS = 16
_N_BITS = 20
_GRAM_FACTOR = 0x9E3779B97F4A7C15
_WINDOW_FACTOR = 0xC2B2AE3D27D4EB4F


class SuffixAutomaton:
    """All stretches of the sequences added so far, over any symbols."""

    def __init__(self) -> None:
        self.ways: list[dict] = [{}]
        self.links = [-1]
        self.sizes = [0]

    def add(self, sequence: list) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _state(self, size: int, ways: dict, link: int) -> int:
        self.ways.append(ways)
        self.sizes.append(size)
        self.links.append(link)
        return len(self.sizes) - 1

    def _split(self, state: int, symbol) -> int:
        """The state of ``state``'s longest stretch and ``symbol``, parted from longer stretches."""
        target = self.ways[state][symbol]
        if self.sizes[target] == self.sizes[state] + 1:
            return target
        copy = self._state(self.sizes[state] + 1, dict(self.ways[target]), self.links[target])
        self.links[target] = copy
        while state >= 0 and self.ways[state].get(symbol) == target:
            self.ways[state][symbol] = copy
            state = self.links[state]
        return copy

    def _extend(self, last: int, symbol) -> int:
        if symbol in self.ways[last]:
            return self._split(last, symbol)
        made = self._state(self.sizes[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.ways[last]:
            self.ways[last][symbol] = made
            last = self.links[last]
        if last >= 0:
            self.links[made] = self._split(last, symbol)
        return made

    def matches(self, sequence: list) -> Iterator[int]:
        """Matching statistics: the length of the longest known stretch that ends at each symbol."""
        state, size = 0, 0
        for symbol in sequence:
            while state and symbol not in self.ways[state]:
                state = self.links[state]
                size = self.sizes[state]
            if symbol in self.ways[state]:
                state = self.ways[state][symbol]
                size += 1
            yield size


def _segments(texts: pa.Array, width: int) -> dict[str, np.ndarray]:
    """The segments of equal anchors of the texts."""
    words, order, starts = distinct_words(texts)
    hashes = np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)[order]
    gram = max(1, width // 2)
    anchors, span, reach = rolling_hash(hashes, gram, _GRAM_FACTOR), 1, width - gram + 1
    place = np.arange(len(anchors))
    while len(anchors) and span < reach:
        step = min(span, reach - span)
        right = anchors[step:] <= anchors[:-step]  # the last of equal grams
        place = np.where(right, place[step:], place[:-step])
        anchors = np.where(right, anchors[step:], anchors[:-step])
        span += step
    text = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(anchors)]
    at = np.flatnonzero(np.arange(len(anchors)) + width <= starts[text + 1])
    windows = rolling_hash(hashes, width, _WINDOW_FACTOR)[at]
    anchors, place, text = anchors[at], place[at], text[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(fresh)
    with np.errstate(over="ignore"):
        within = (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))).astype(np.uint64)
        content = np.add.reduceat(mixed(windows + within), first) if len(first) else np.empty(0, np.uint64)
    found = {
        "anchor": anchors[first],
        "content": content,
        "text": text[first],
        "start": at[first] - starts[text[first]],
        "n": np.diff(np.append(first, len(at))),
    }
    return found


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _filled(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


class BitMap:
    """A set of rows of numbers in a table of bits; it may hold more than was put in."""

    def __init__(self, rows: DataFrame, most: int) -> None:
        """The set of all rows, at most ``most``, put together from blocks of the table."""
        bits_of = self.size = min(MOST_MAP_BITS, max(LEAST_MAP_BITS, (MAP_SHARE * most).bit_length()))
        block = F.shiftright("slot", _MAP_BLOCK_BITS).alias("block")

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.unique(BitMap.slots([_filled(c) for c in batch.columns], bits_of))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["slot"])

        def packed(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(1 << _MAP_BLOCK_BITS, bool)
            bits[found["slot"].to_numpy() & ((1 << _MAP_BLOCK_BITS) - 1)] = True
            return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits).tobytes()]})

        used = rows.mapInArrow(slots, "slot long").distinct().groupBy(block)
        whole = np.zeros((1 << (bits_of - _MAP_BLOCK_BITS), 1 << (_MAP_BLOCK_BITS - 3)), np.uint8)
        for row in used.applyInPandas(packed, "block long, bits binary").collect():
            whole[row.block] = np.frombuffer(row.bits, np.uint8)
        self.bits = whole.ravel()

    @staticmethod
    def slots(columns: list[np.ndarray], bits: int) -> np.ndarray:
        """The slots of each row in a table of 2 to the ``bits``, one line for each probe."""
        hashed = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            hashed = mixed(hashed ^ column)
        return np.stack([mixed(hashed + np.uint64(i)) >> np.uint64(64 - bits) for i in range(_MAP_PROBES)])

    def may_hold(self, columns: list[np.ndarray]) -> np.ndarray:
        slots = self.slots(columns, self.size)
        bits = (self.bits[slots >> np.uint64(3)] >> (7 - (slots & np.uint64(7))).astype(np.uint8)) & 1
        return bits.all(axis=0)


def _segment_rows(docs: DataFrame, firsts, width: int) -> DataFrame:
    """(anchor, content, doc_id, text_key, at) of all segments of the documents that ``firsts`` may hold.

    ``at`` has the segment's first word and its number of windows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches):
            own = np.flatnonzero(firsts.value.may_hold([_filled(c) for c in batch.columns[:3]]))
            kept = batch.take(pa.array(own))
            every = _segments(kept.column(3), width)
            at = pa.array(every["text"])
            columns = [
                _signed(every["anchor"]),
                _signed(every["content"]),
                kept.column(0).take(at),
                kept.column(1).take(at),
                pa.array(every["start"] << _N_BITS | every["n"]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "doc_id", "text_key", "at"])

    schema = "anchor long, content long, doc_id long, text_key long, at long"
    return docs.select("doc_id", "text_key", "text_key2", "text").mapInArrow(found, schema)


def _passed(rows: DataFrame, sent, columns: list[str], wanted: bool) -> DataFrame:
    """The rows whose columns the broadcast bit map may hold, or certainly does not hold."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = sent.value.may_hold([_filled(batch.column(c)) for c in columns])
            yield batch.filter(pa.array(held == wanted))

    return rows.mapInArrow(kept, rows.schema)


def _words_at(docs: DataFrame, places: DataFrame, most: int, width: int) -> DataFrame:
    """(doc_id, text_key, start, words): what follows the places (doc_id, text_key, start) of the documents.

    As long as a bit map of the places, at most ``most``, is nearly empty, it picks them out of the
    documents where these are, with a few others. Beyond that the documents meet their places in a join.
    """
    texts = docs.select("doc_id", "text_key", "text")
    if MAP_SHARE * most < 1 << MOST_MAP_BITS:
        sent = docs.sparkSession.sparkContext.broadcast(BitMap(places, most))
        return _carried(texts, width, lambda batch, starts: _mapped(batch, starts, sent.value))
    own = places.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    own = own.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "starts")
    same = (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))
    met = texts.join(own, same).select("doc_id", "text_key", "text", "starts")
    return _carried(met, width, lambda batch, starts: _listed(batch))


def _mapped(batch: pa.RecordBatch, starts: np.ndarray, wanted: BitMap) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of the places the map may hold."""
    text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
    start = np.arange(starts[-1]) - starts[text]
    ids, keys = (_filled(batch.column(i))[text] for i in (0, 1))
    passed = np.flatnonzero(wanted.may_hold([ids, keys, start.view(np.uint64)]))
    return text[passed], start[passed]


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of the places that stand in the rows."""
    lists = batch.column(3)
    return np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def _carried(rows: DataFrame, width: int, chosen) -> DataFrame:
    """The words behind the chosen places of the rows' texts."""
    longest = 2 * width - max(1, width // 2)  # an anchor lies in all windows of its segment

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words, starts = flat([text.split() for text in texts])
            text, start = chosen(batch, starts)
            begins = starts[text] + start
            ends = np.minimum(begins + longest, starts[text + 1])
            carried = [b" ".join(words[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            at = pa.array(text)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(carried, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "start", "words"])

    return rows.mapInArrow(found, "doc_id long, text_key long, start long, words binary")


def _shared_windows(contents: DataFrame, large: DataFrame, width: int) -> DataFrame:
    """(anchor, content, offsets): windows that an earlier content of the anchor has as well.

    ``large`` has the anchors whose contents are compared window by window.
    """

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by anchor and first place, so one automaton is open at a time.
        anchor, content, automaton = None, None, SuffixAutomaton()
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                sequence = row.words.split()[: row.n + width - 1]
                if row.anchor != anchor:
                    anchor, automaton = row.anchor, SuffixAutomaton()
                elif row.content == content:
                    continue  # a repeated row of one document
                content = row.content
                ends = [i for i, size in enumerate(automaton.matches(sequence)) if size >= width]
                if ends:
                    rows.append((row.anchor, row.content, [i - width + 1 for i in ends]))
                automaton.add(sequence)
            yield pd.DataFrame(rows, columns=["anchor", "content", "offsets"])

    schema = "anchor long, content long, offsets array<long>"
    any_large = not large.isEmpty()
    dealt = contents.join(large, "anchor", "left_anti") if any_large else contents
    dealt = dealt.select("anchor", "content", "doc_id", "text_key", "at", _count().alias("n"), "words")
    streamed = dealt.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_key", "at")
    small = streamed.mapInPandas(shared, schema)
    if not any_large:
        return small

    each = contents.join(large, "anchor", "left_semi")
    words = F.split(F.col("words").cast("string"), " ")
    offsets = F.sequence(F.lit(0).cast("long"), _count() - 1)
    each = each.select("anchor", "content", "doc_id", "text_key", _start().alias("start"), F.posexplode(F.transform(
        offsets, lambda o: F.slice(words, o.cast("int") + 1, F.lit(width))
    )).alias("offset", "window"))
    each = each.withColumn("hash", F.struct(F.xxhash64("window"), F.xxhash64(F.lit(1), "window")))
    place = F.struct("doc_id", "text_key", (F.col("start") + F.col("offset")).alias("start"))
    each = each.select("anchor", "content", "hash", "offset", place.alias("place"))
    earliest = each.groupBy("hash").agg(F.min("place").alias("earliest"))
    later = each.join(earliest, "hash").where(F.col("place") != F.col("earliest"))
    cut = later.groupBy("anchor", "content").agg(F.collect_list(F.col("offset").cast("long")).alias("offsets"))
    return small.unionByName(cut)


def _start() -> Column:
    return F.shiftright("at", _N_BITS)


def _count() -> Column:
    return F.col("at").bitwiseAND(F.lit((1 << _N_BITS) - 1))


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = new_table_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def repeated_spans(docs: DataFrame, firsts, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, begin, end) of word spans that repeats cover.

    ``docs`` has (doc_id, text_key, text_key2, text); documents that the broadcast ``firsts``
    certainly does not hold are left out.
    """
    send = docs.sparkSession.sparkContext.broadcast
    segments = _written(_segment_rows(docs, firsts, width), "segments")
    anchors = segments.groupBy("anchor").count().where("count > 1").select("anchor")
    places = _passed(segments, send(BitMap(anchors, segments.count())), ["anchor"], True)
    place = F.struct("doc_id", "text_key", "at")
    contents = places.groupBy("anchor", "content").agg(F.min(place).alias("first")).select("anchor", "content", "first.*")
    contents = _written(contents, "contents")

    shared = contents.groupBy("anchor").count().where("count > 1").select("anchor")
    several = contents.join(shared, "anchor", "left_semi")
    most = contents.count()
    words = _words_at(docs, several.select("doc_id", "text_key", _start().alias("start")), most, width)
    of = [F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")]
    same = (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))
    words = words.select(*of, F.col("start").alias("of_start"), "words")
    several = several.join(words, (_start() == F.col("of_start")) & same).drop("of", "of_key", "of_start")
    large = contents.groupBy("anchor").count().where(F.col("count") > SHARD_CONTENTS).select("anchor")
    found = _written(_shared_windows(several, large, width), "shared-windows")

    start = _start()
    whole = F.struct(start.alias("begin"), (start + _count() + width - 1).alias("end"))
    keys = ["anchor", "content", "doc_id", "text_key", "at"]
    first = send(BitMap(contents.select(*keys), most))
    later = _passed(places, first, keys, False).select("doc_id", "text_key", whole.alias("span"))
    later = later.select("doc_id", "text_key", "span.*")

    judged = contents.join(found, ["anchor", "content"], "left")
    judged = judged.select("anchor", "content", *of, F.col("at").alias("of_at"), "offsets")
    met = _passed(places, first, keys, True).join(judged, ["anchor", "content"])
    some = F.transform("offsets", lambda o: F.struct((start + o).alias("begin"), (start + o + width).alias("end")))
    spans = F.when((F.col("at") == F.col("of_at")) & same, some).otherwise(F.array(whole))
    return later.unionByName(met.select("doc_id", "text_key", F.inline(spans)))


def _cutter(firsts, width: int):
    def cut(doc_id: pd.Series, key: pd.Series, key2: pd.Series, texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        columns = [c.to_numpy(np.int64).view(np.uint64) for c in (doc_id, key, key2)]
        rows = []
        for text, own, first in zip(texts, spans, firsts.value.may_hold(columns), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for span in own if own is not None else ():
                gone[span["begin"]] += 1
                gone[span["end"]] -= 1
            if not first and len(words) >= width:
                gone[0] = 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
            rows.append((b" ".join(kept).decode(), len(words), len(words) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_words", "n_removed"])

    return F.pandas_udf(cut, "text string, n_words long, n_removed long")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row: the words that stay, joined by one blank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    second = F.xxhash64("text", F.lit(1)).alias("text_key2")
    keyed = keyed.select("doc_id", F.xxhash64("text").alias("text_key"), second, "text")
    copies = keyed.groupBy("text_key", "text_key2").agg(F.min(F.struct("doc_id")).alias("first"))
    firsts = BitMap(copies.select("first.doc_id", "text_key", "text_key2"), keyed.count())
    firsts = docs.sparkSession.sparkContext.broadcast(firsts)
    spans = repeated_spans(keyed, firsts, width).groupBy("doc_id", "text_key")
    spans = spans.agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "spans")
    same = (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))
    met = keyed.join(spans, same, "left")
    known_id = F.coalesce("doc_id", F.lit(0).cast("long"))
    kept = _cutter(firsts, width)(known_id, "text_key", "text_key2", "text", "spans")
    return met.select("doc_id", kept.alias("kept")).select("doc_id", "kept.*")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words covered by windows that occurred earlier."""
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
