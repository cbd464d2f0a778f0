"""Base scores by counting; the mixed score restated number by number in plain Python."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from gradeworks.llm import context_mixing as cm
from llm.support import fold, in_order, order, read_rows, words_of

MASK = (1 << 64) - 1


def tokens(text):
    return [*words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), b"\n"]


def expected(rows):
    counts = Counter(w for i, t in rows if fold(i, 7) != 2 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        yield i, fold(i, 7) == 2, len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)


@pytest.mark.parametrize("head", [200_000, 50])
@pytest.mark.parametrize("where", ["edge", "small", "larger than a slice"])
def test_base_scores(spark, edge_folder, monkeypatch, where, head):
    monkeypatch.setattr(cm, "HEAD_WORDS", head)
    folder = {"edge": edge_folder, "small": SMALL}.get(where, "/root/testdata/sf0.01")
    found = cm.op10_context_mixing(spark, folder).collect()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    got = [(*(r[n] for n in names), round(r.base_score, 6)) for r in found]
    for a, b in zip(in_order(got), in_order(expected(read_rows(folder))), strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=2e-6)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    alike = {}
    for r in found:
        assert alike.setdefault((order((r.doc_id,)), r.n_tokens, round(r.base_score, 6)), r.score) == pytest.approx(r.score)


def test_empty_table(spark, empty_folder):
    assert cm.op10_context_mixing(spark, empty_folder).collect() == []


# ------------------------------------------------ a restatement without arrays, hash by hash


def mix64(x):
    x = ((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 29)) * 0xC2B2AE3D27D4EB4F) & MASK
    return x ^ (x >> 32)


def stretch(zeros, ones):
    return math.log((ones + 0.4) / (zeros + 0.4))


def squash(x):
    return 1 / (1 + math.exp(-min(15, max(-15, x))))


def seen(total):
    return (total > 0.5) + (total > 1.5) + (total > 4.5) + (total > 32.5)


def slot(context, byte, bit, bits):
    return mix64((context + mix64((1 << bit) | (byte >> (8 - bit)))) & MASK) >> (64 - bits)


class PlainMixer:
    def __init__(self, inputs):
        self.weights = defaultdict(lambda: [1.2 / inputs] * inputs)
        self.refined = defaultdict(lambda: [squash(-8 + c / 2) for c in range(33)])

    def _at(self, x, set_, row):
        mix = sum(a * b for a, b in zip(x, self.weights[set_], strict=True))
        scaled = (min(8 - 1e-5, max(-8, mix)) + 8) * 2
        return mix, int(scaled), scaled - int(scaled)

    def predict(self, x, set_, row):
        mix, low, part = self._at(x, set_, row)
        cells = self.refined[row]
        refined = cells[low] * (1 - part) + cells[low + 1] * part
        return min(1 - 1e-6, max(1e-6, (squash(mix) + refined) / 2))

    def learn(self, examples):
        """Examples (inputs, set, row, bit, times) of one step."""
        pull, each = defaultdict(lambda: [0.0] * 4), defaultdict(lambda: 20.0)
        wanted, weight = defaultdict(float), defaultdict(float)
        for x, set_, row, bit, times in examples:
            mix, low, part = self._at(x, set_, row)
            each[set_] += times
            for i, a in enumerate(x):
                pull[set_][i] += (bit - squash(mix)) * times * a
            for cell, share in ((low, (1 - part) * times), (low + 1, part * times)):
                wanted[row, cell] += share * bit
                weight[row, cell] += share
        for set_ in each:
            self.weights[set_] = [w + cm.RATE * pull[set_][i] / each[set_] for i, w in enumerate(self.weights[set_])]
        for (row, cell), w in weight.items():
            self.refined[row][cell] += (wanted[row, cell] - w * self.refined[row][cell]) / (w + 200)


def bit_of(byte, bit):
    return (byte >> (7 - bit)) & 1


def plain_places(word):
    """(place, byte, contexts, prefix) of the bytes behind the first."""
    closed, prefix = word + b" " if word != b"\n" else word, 0
    for place, byte in enumerate(closed):
        if place:
            recent = [sum(closed[place - b] << 8 * (b - 1) for b in range(1, k + 1) if place >= b) + (k << 60) for k in (1, 2, 3)]
            yield place, byte, recent, prefix
        prefix = (prefix + mix64(byte + place * 256)) & MASK


def plain_word_costs(train, every):
    pairs = Counter()
    for word, n in train.items():
        for _, byte, recent, _ in plain_places(word):
            for context in recent:
                pairs[context, byte] += n
    bits = max(16, (8 * len(pairs)).bit_length())
    shared = defaultdict(lambda: [0, 0])
    for (context, byte), n in pairs.items():
        for bit in range(8):
            shared[slot(context, byte, bit, bits)][bit_of(byte, bit)] += n
    spots = sum(1 for w in train for _ in plain_places(w))
    own_bits = max(8, (8 * spots).bit_length())
    own = defaultdict(lambda: [0, 0])
    for word, n in train.items():
        for _, byte, _, prefix in plain_places(word):
            for bit in range(8):
                own[slot(prefix, byte, bit, own_bits)][bit_of(byte, bit)] += n

    def example(where, bit, without=0):
        place, byte, recent, prefix = where
        x = [max(-127, min(127, round(16 * stretch(*shared[slot(c, byte, bit, bits)])))) / 16 for c in recent]
        zeros, ones = own[slot(prefix, byte, bit, own_bits)]
        if without:
            zeros, ones = max(0, zeros - (bit_of(byte, bit) == 0)), max(0, ones - (bit_of(byte, bit) == 1))
        row = seen(zeros + ones)
        return [*x, stretch(zeros, ones)], (min(place - 1, cm.PLACES - 1), bit, row), row

    def learn(words):
        words = [w for w in words if train[w]]
        for bit in range(8):
            mixer.learn([(*example(p, bit, 1), bit_of(p[1], bit), train[w] ** 0.5) for w in words for p in plain_places(w)])

    draw = {w: xxhash.xxh64_intdigest(w, 7) for w in every}
    words = sorted(every, key=draw.get)
    mixer = PlainMixer(4)
    few = [w for w in words if draw[w] % cm.LEARN_SHARE == 0]
    for start in range(0, len(few), cm.LEARN_CHUNK):
        learn(few[start : start + cm.LEARN_CHUNK])
    costs = {}
    for start in range(0, len(words), cm.CHUNK):
        chunk = words[start : start + cm.CHUNK]
        for w in chunk:
            ps = [(mixer.predict(*example(p, bit)), bit_of(p[1], bit)) for p in plain_places(w) for bit in range(8)]
            costs[w] = sum(math.log10(p if b else 1 - p) for p, b in ps)
        learn(chunk[:: cm.LEARN_SHARE])
    return costs


def plain_first_costs(pairs, bits):
    """Cost of a first byte after each class, from counts by (class, byte)."""
    mixer = PlainMixer(3)
    by_kind, total = Counter(), Counter()
    for (c, byte), n in pairs.items():
        by_kind[c % 4, byte] += n
        total[byte] += n

    def node(counts, key, bit, begin):
        sums = [0, 0]
        for byte in range(256):
            if byte >> (8 - bit) == begin:
                sums[bit_of(byte, bit)] += counts[(*key, byte) if key else byte]
        return sums

    def example(c, bit, begin, without=None):
        zeros, ones = node(pairs, (c,), bit, begin)
        zeros, ones = max(0, zeros - (without == 0)), max(0, ones - (without == 1))
        row = seen(zeros + ones)
        x = [stretch(zeros, ones), stretch(*node(by_kind, (c % 4,), bit, begin)), stretch(*node(total, (), bit, begin))]
        return x, (bit, row), row

    classes = sorted({c for c, _ in pairs})
    for low in range(0, 1 << bits, 256):
        for bit in range(8):
            examples = []
            for c in (c for c in classes if low <= c < low + 256):
                for begin in range(1 << bit):
                    for value, n in enumerate(node(pairs, (c,), bit, begin)):
                        if n:
                            examples.append((*example(c, bit, begin, value), value, n))
            if examples:
                for _ in range(cm.FIRST_STEPS):
                    mixer.learn(examples)

    def cost(c, byte):
        ps = [(mixer.predict(*example(c, bit, byte >> (8 - bit))), bit_of(byte, bit)) for bit in range(8)]
        return sum(math.log10(p if b else 1 - p) for p, b in ps)

    return cost


def test_score_restated(spark, documents):
    rows = sorted(read_rows(SMALL), key=lambda r: len(r[1] or ""))[20:70]
    folder = documents(rows)
    bits = max(cm.LEAST_CLASS_BITS, len(rows).bit_length() - 6)

    def class_of(word):
        return (mix64(xxhash.xxh64_intdigest(word)) % ((1 << bits) // 4)) * 4 + cm._kind(word)

    train, every, pairs = Counter(), set(), Counter()
    for i, t in rows:
        own = tokens(t)
        every.update(own)
        if fold(i, 7) != 2:
            train.update(own)
            pairs.update(zip([0, *map(class_of, own)], [w[0] for w in own], strict=False))
    costs, first = plain_word_costs(train, every), plain_first_costs(pairs, bits)
    found = {r.doc_id: r for r in cm.op10_context_mixing(spark, folder).collect()}
    for i, t in rows:
        own = tokens(t)
        wanted = sum(costs[w] + first(c, w[0]) for c, w in zip([0, *map(class_of, own)], own, strict=False))
        assert found[i].score == pytest.approx(wanted, rel=1e-4)
        assert found[i].bits_per_byte == pytest.approx(-wanted * math.log2(10) / max(1, len((t or "").encode())), rel=1e-4)


def test_every_training_word_is_learned_from(spark, documents, monkeypatch):
    rows = sorted(read_rows(SMALL), key=lambda r: len(r[1] or ""))[20:50]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    words = cm.count_tokens(docs, ~cm.held_out(F.col("doc_id")), 6).where("word IS NOT NULL")
    total = words.count()
    costs = cm.word_costs(words, total, cm.slot_table(cm.context_pairs(words))).join(words.select("hash", "word"), "hash")
    found = {bytes(r.word): r.cost for r in costs.collect()}
    train = Counter(w for i, t in rows if fold(i, 7) != 2 for w in tokens(t))
    monkeypatch.setattr(cm, "LEARN_SHARE", 1)
    wanted = plain_word_costs(train, {w for _, t in rows for w in tokens(t)})
    assert found.keys() == wanted.keys() and len(train) > 300
    assert all(found[w] == pytest.approx(wanted[w], rel=1e-4, abs=1e-5) for w in wanted)


def test_order_of_words_matters(spark, documents):
    rows = [(1, "the cat sat on the mat"), (2, "mat the on sat cat the")] + [(10 + i, "the cat sat on the mat") for i in range(20)]
    found = {r.doc_id: r.score for r in cm.op10_context_mixing(spark, documents(rows)).collect()}
    assert found[1] > found[2] + 0.1


def test_large_keys_are_dealt_to_several_groups(spark, documents, monkeypatch):
    """Many words with the same first bytes, as addresses have."""
    monkeypatch.setattr(cm, "GROUP_WORDS", 40)
    rows = [(i, f"https://example.org/{i * 7919 % 1000} and {i}") for i in range(300)]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    words = cm.count_tokens(docs, F.lit(True), 6).where("word IS NOT NULL")
    sizes = cm.grouped_words(words).groupBy("key", "piece").count().collect()
    assert max(r["count"] for r in sizes) < 100
    found = cm.op10_context_mixing(spark, documents(rows)).collect()
    assert len(found) == 300 and all(math.isfinite(r.score) for r in found)


def test_scores_do_not_follow_the_size_of_groups(spark, monkeypatch):
    """A group that counts its own words only takes them for likelier than they are, the more so the smaller it is."""
    means = []
    for words in (1 << 20, 1 << 11):
        monkeypatch.setattr(cm, "GROUP_WORDS", words)
        bits = [r.bits_per_byte for r in cm.op10_context_mixing(spark, SMALL).collect() if r.n_tokens > 50]
        means.append(sum(bits) / len(bits))
    assert means[0] == pytest.approx(means[1], abs=0.1)


def test_counts_after_short_prefixes(spark, documents, monkeypatch):
    monkeypatch.setattr(cm, "GROUP_WORDS", 5)
    rows = [(i, f"https://a.org/{i % 7} the then to {'x' * i} Ⅷ{i}") for i in range(1, 40)]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    words = cm.grouped_words(cm.count_tokens(docs, ~cm.held_out(F.col("doc_id")), 6).where("word IS NOT NULL"))
    dealt = words.withColumn("group", F.pmod(F.xxhash64("key", "piece"), F.lit(9))).collect()
    found = {(r.group, r.prefix): {a.byte: a.n for a in r.after} for r in cm.stem_counts(spark.createDataFrame(dealt)).collect()}
    every, wanted = defaultdict(Counter), set()
    for r in dealt:
        for place, byte, _, prefix in plain_places(bytes(r.word)):
            prefix -= (prefix >> 63) << 64
            every[prefix][byte] += r.n
            if place < r.depth:
                wanted.add((r.group, prefix))
    assert max(r.depth for r in dealt) == 64 and len({g for g, _ in wanted}) > 5
    assert found == {(g, p): {b: n for b, n in every[p].items() if n} for g, p in wanted if any(every[p].values())}
    # From a word's depth on no other group has the prefix.
    homes = defaultdict(set)
    for r in dealt:
        for place, _, _, prefix in plain_places(bytes(r.word)):
            homes[prefix].add((r.group, place >= r.depth))
    assert all(len(x) == 1 for x in homes.values() if any(own for _, own in x))


class Handed:
    """Stands for a table and keeps the function that its rows are to be mapped by."""

    def __getattr__(self, name):
        return lambda *args, **kwargs: self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def test_memory_of_counting_contexts(spark):
    """A task counts the contexts of many words in parts; what it holds meanwhile does not follow the words."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, row)).encode() for row in rng.integers(97, 123, (100_000, 8))]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([1] * len(words))], ["word", "n"])
    table = Handed()
    cm.context_pairs(table)
    tracemalloc.start()
    pairs = sum(int(pc.sum(b["n"]).as_py()) for b in table.function(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 8 * 3 * len(words)
    assert peak < 80e6


def test_learning_takes_one_python_worker_a_task(spark, monkeypatch):
    plans = []

    def average(parts, start):
        plans.append(parts._jdf.queryExecution().executedPlan().toString())
        return start

    monkeypatch.setattr(cm, "_average", average)
    words = spark.createDataFrame([(1, bytearray(b"ab"), 3)], "hash long, word binary, n long")
    cm.word_costs(words, 1, np.zeros(1 << cm.LEAST_SLOT_BITS, np.int8))
    monkeypatch.undo()
    assert plans[0].count("InArrow") == 1
    # Two steps in all, each with weights and map of 0.25: no other Python node is needed for their mean.
    mixer = cm.Mixer.start(cm.WORD_SETS, cm.WORD_INPUTS, cm.SEEN)
    last = mixer.weights.size + mixer.refined.size
    cells = spark.range(last + 1).selectExpr("id AS cell", f"if(id = {last}, 2D, 0.5D) AS s")
    found = cm._average(cells, mixer)
    assert (found.weights == 0.25).all() and (found.refined == 0.25).all()


def test_probabilities_of_first_bytes_add_up():
    pairs = np.zeros((64, 256), np.int64)
    pairs[0, [97, 98]], pairs[5, [99, 10]] = (5, 1), (1, 30)
    costs = cm.first_byte_costs(pairs)
    assert np.allclose((10.0 ** costs.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert costs[0, 97] > costs[0, 99]


def test_parts_of_a_batch_are_read_as_the_whole():
    texts = pa.array(["AB cd"] * 5 + ["EF  gh\nij", None, "Ⅷ É x"])
    index = cm.WordIndex(6)
    numbers, starts, _ = index.tokens(texts.slice(5))
    assert [index.words[i] for i in numbers] == [b"ef", b"gh", b"ij", b"\n", b"\n", "Ⅷ".encode(), "É".encode(), b"x", b"\n"]
    assert starts.tolist() == [0, 4, 5, 9]


def test_known_texts_cost_less(spark):
    found = cm.op10_context_mixing(spark, "/root/testdata/sf0.01").collect()
    bits = [r.bits_per_byte for r in found if r.held_out and r.n_tokens > 50]
    assert 1 < sum(bits) / len(bits) < 2.3
