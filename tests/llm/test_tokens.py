"""Token files, token counts, and encoding against the tokenizers library itself."""

import hashlib
import io
import itertools
import sys
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradeworks.llm import bpe, token_counts, token_files
from gradeworks.llm.vocabulary import load_vocabulary
from llm.support import in_order, order, read_rows

SMALL = "/root/testdata/sf0.001"
FOLDERS = ["edge", "small"]


@pytest.fixture
def folder(request, edge_folder):
    return edge_folder if request.param == "edge" else SMALL


def library(path):
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def ids_of(made, text):
    return made.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("folder", FOLDERS, indirect=True)
def test_token_files(spark, folder):
    made = library(token_files.TOKENIZER)
    found = token_files.op3_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    rows = [(i, [*ids_of(made, t), 2]) for i, t in read_rows(folder)]
    by_start = sorted(found, key=lambda r: r.start)
    assert [order((r.doc_id,)) for r in by_start] == sorted(order((i,)) for i, _ in rows)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    assert in_order((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == in_order(
        (i, len(ids), zlib.crc32(packed(ids))) for i, ids in rows
    )


def test_empty_tables(spark, empty_folder):
    assert token_files.op3_token_files(spark, empty_folder).collect() == []
    assert token_counts.op4_token_counts(spark, empty_folder).collect() == []
    assert bpe.op6_bpe(spark, empty_folder).collect() == []


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("kind", ["byte", "bit"])
@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=50), max_size=30), st.integers(1, 9))
def test_file_round_trip(kind, documents, block):
    token_files.BLOCK_IDS = block
    try:
        out = Buffer()
        writer = token_files.PlaneWriter(out, kind)
        for number, ids in enumerate(documents):
            writer.add([number], np.array(ids, np.uint32), np.array([len(ids)]))
        writer.close()
        reader = token_files.PlaneReader(out)
        every = [i for ids in documents for i in ids]
        assert reader.ids(0, len(every)).tolist() == every
        for number, ids in enumerate(documents):
            assert reader.ids(reader.ends[number], reader.ends[number + 1]).tolist() == ids
        parts = [ids.tolist() for _, _, ids in reader.documents()]
        assert [i for part in parts for i in part] == every
    finally:
        token_files.BLOCK_IDS = 1 << 16


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        token_files.PlaneReader(Buffer(b"x" * 100))


@pytest.mark.parametrize("folder", FOLDERS, indirect=True)
def test_token_counts(spark, folder):
    made = library(token_counts.TOKENIZER)
    found = token_counts.op4_token_counts(spark, folder)
    expected = []
    for i, t in read_rows(folder):
        n = len(ids_of(made, t))
        expected.append((i, len((t or "").encode()), n, n > 2048))
    assert in_order(found.collect()) == in_order(expected)


def test_whole_tokens_are_proven():
    whole = token_counts.whole_tokens(token_counts.TOKENIZER)
    made, vocabulary = library(token_counts.TOKENIZER), load_vocabulary(token_counts.TOKENIZER)
    assert 30_000 < len(whole) <= len(vocabulary.ids)
    for word in sorted(whole)[::97]:
        assert len(ids_of(made, word)) == 1 or word != word.lower()


@pytest.mark.parametrize("folder", FOLDERS, indirect=True)
def test_round_trip_digests(spark, folder):
    made = library(bpe.TOKENIZER)
    found = bpe.op6_bpe(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = []
    for i, t in read_rows(folder):
        ids = ids_of(made, t)
        decoded = made.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert in_order(found.collect()) == in_order(expected)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghi aAé'.1日\n", max_size=40), min_size=1, max_size=8))
def test_pair_index_against_library(texts):
    made = library(bpe.TOKENIZER)
    table, pattern = bpe._pieces(bpe.TOKENIZER)
    for text in texts:
        ids, _ = table.look_up(bpe._cut(text, pattern, ["<|endoftext|>"]))
        assert ids.tolist() == ids_of(made, text)


@pytest.mark.parametrize("many", [1, 3, 1 << 40])
@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.text(alphabet="aaabehnt .!é", max_size=40), max_size=30))
def test_pairs_are_merged_at_once_or_one_by_one(many, texts):
    made, index = library(bpe.TOKENIZER), bpe.PairIndex(load_vocabulary(bpe.TOKENIZER))
    words = [w for text in texts for w in regex.findall(bpe._PRE_TOKEN, text)]
    before = bpe.MANY
    bpe.MANY = many
    try:
        ids, sizes = index.encode([w.encode() for w in words])
    finally:
        bpe.MANY = before
    wanted = [ids_of(made, w) for w in words]
    assert ids.tolist() == [i for own in wanted for i in own]
    assert sizes.tolist() == [len(own) for own in wanted]


def test_frequent_pairs_cost_less_than_a_call_a_merge():
    parts = ["ba", "con", "der", "ing", "lo", "mar", "ster", "ti", "und", "ver"]
    words = [" " + "".join(p) for p in itertools.product(parts, repeat=4)]
    index = bpe.PairIndex(load_vocabulary(bpe.TOKENIZER))
    calls = 0

    def count(_, event, __):
        nonlocal calls
        calls += event in ("call", "c_call")

    profile = sys.getprofile()
    sys.setprofile(count)
    try:
        ids, _ = index.encode([w.encode() for w in words])
    finally:
        sys.setprofile(profile)
    merges = sum(map(len, words)) - len(ids)
    assert merges > 50_000 and calls < merges / 2


def random_texts(count):
    """Random strings over all of Unicode and over its trickier parts."""
    draw = np.random.default_rng(11)
    ranges = [(0, 0x80), (0, 0x250), (0x250, 0x3100), (0x300, 0x370), (0x1100, 0xD7FF), (0xE000, 0x110000)]
    known = ["\u0130\u0327", "\u0c5c", "\u0cdc", "\u088f", "\u208f", "りたい", "ΣΑΣ", "ﬁ", "\u1e9b\u0323", "<|endoftext|>", "'s"]
    for _ in range(count):
        letters = []
        for _ in range(draw.integers(1, 12)):
            low, high = ranges[draw.integers(len(ranges))]
            code = int(draw.integers(low, high))
            letters.append(" " if 0xD800 <= code < 0xE000 else chr(code))
            if draw.random() < 0.1:
                letters.append(known[draw.integers(len(known))])
        yield "".join(letters)


def test_random_strings_are_encoded_as_the_library_does():
    made = library(token_files.TOKENIZER)
    whole = token_counts.whole_tokens(token_counts.TOKENIZER)
    counter = token_counts.ChunkCounts(token_counts.TOKENIZER, whole)
    table = token_files._library_pieces(token_files.TOKENIZER)
    for text in random_texts(10_000):
        wanted, chunks = ids_of(made, text), text.encode().split()
        assert table.look_up(chunks)[0].tolist() == wanted, ascii(text)
        assert counter.look_up(chunks).sum() == len(wanted), ascii(text)


def test_every_proven_string_is_one_token_of_the_library():
    made = library(token_counts.TOKENIZER)
    whole = sorted(token_counts.whole_tokens(token_counts.TOKENIZER))
    assert len(whole) > 30_000
    found = made.encode_batch(whole, add_special_tokens=False)
    assert [w for w, e in zip(whole, found, strict=True) if len(e.ids) != 1] == []


def test_repeated_rows_are_split_over_files(spark, documents, tmp_path):
    rows = [(5, "the same row")] * 3000 + [(i, f"own {i}") for i in range(1000)]
    folder = f"file://{tmp_path}/tokens"
    docs = spark.read.parquet(documents(rows) + "/documents.parquet").repartition(4)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")
    try:
        token_files.write_tokens(docs, folder)
    finally:
        spark.conf.set(merge, before)
    sizes = [r.n_docs for r in spark.read.parquet(f"{folder}/files").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
