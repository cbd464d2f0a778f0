import random

import numpy as np
import pytest

from gradeworks.llm import decontamination as dc
from llm.conftest import sentence
from llm.support import in_order, read_rows

SMALL = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def sequence(text):
    return [s for w in (text or "").lower().split() if (s := w.strip(dc.string.punctuation))]


def distance(item, words):
    """Smallest edit distance of the item to any stretch of the words."""
    row = [0] * (len(words) + 1)
    for n, a in enumerate(item, 1):
        above = [n]
        for j, b in enumerate(words, 1):
            above.append(min(row[j - 1] + (a != b), row[j] + 1, above[-1] + 1))
        row = above
    return min(row)


def brute(docs, items):
    for doc_id, text in docs:
        words = sequence(text)
        for item_id, item in items:
            own = sequence(item)
            if own and set(own) & set(words) and (d := distance(own, words)) <= int(0.2 * len(own) + 1e-9):
                yield doc_id, item_id, d


def found_in(spark, docs, items, share=0.2):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return dc.find_leaks(frame, bench, share).collect()


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[at] = "changed"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "added")
    return words


def test_recall_of_edited_items(spark):
    draw = random.Random(1)
    items = [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randrange(15, 60)))) for i in range(30)]
    docs, wanted = [], set()
    for n in range(300):
        item_id, item = items[n % 30]
        words = item.split()
        leak = edited(draw, words, draw.randrange(1 + len(words) // 5))
        around = [[draw.choice(WORDS) for _ in range(draw.randrange(80))] for _ in range(2)]
        docs.append((n, " ".join([*around[0], *leak, *around[1]]).title().replace(" ", ", ", 3)))
    wanted = {(d, i) for d, i, _ in brute(docs, items)}
    found = found_in(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(wanted) >= 290 and got <= wanted
    assert len(got) >= 0.97 * len(wanted)
    exact = {(r.doc_id, r.item_id): r.edits for r in found}
    true = {(d, i): e for d, i, e in brute(docs, items)}
    assert all(exact[k] == true[k] for k in exact)


def test_rows_of_the_tables(spark):
    found = dc.op2_decontamination(spark, SMALL)
    assert found.columns == ["doc_id", "item_id", "first_word", "last_word", "edits"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = read_rows(SMALL)
    texts = dict(docs)
    rows = found.collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in rows} == set(brute(docs, items))
    for r in rows:
        stretch = sequence(texts[r.doc_id])[r.first_word : r.last_word + 1]
        if r.edits == 0:
            assert stretch == sequence(dict(items)[r.item_id])


def test_edge_rows(spark, edge_folder, tmp_path):
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    shared = dict(read_rows(edge_folder))[13]
    items = [(0, shared), (1, None), (2, ""), (3, "one"), (4, "..."), (None, shared), (0, shared), (5, "never seen words at all here")]
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, fp long")
    found = dc.find_leaks(docs, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {d for d, i in got if i == 0} == {13, 14, 15, 16, 17} == {d for d, i in got if i is None}
    assert (4, 3) in got and not {i for _, i in got} & {1, 2, 4, 5}
    clean = dc.without_leaks(docs, bench.where("item_id = 0"))
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert not left & {13, 14, 15, 16, 17} and {None, 0, 1, 4, 12, 100} <= left


def test_blocks_of_items(spark, monkeypatch):
    whole = in_order(dc.op2_decontamination(spark, SMALL).collect())
    monkeypatch.setattr(dc, "ITEMS_PER_BLOCK", 9)
    assert in_order(dc.op2_decontamination(spark, SMALL).collect()) == whole


def test_empty_tables(spark, empty_folder):
    assert dc.op2_decontamination(spark, empty_folder).collect() == []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    none = spark.read.parquet(f"{empty_folder}/benchmark.parquet")
    assert dc.find_leaks(docs, none).collect() == []
    assert dc.without_leaks(docs, none).count() == docs.count()


@pytest.mark.parametrize("anchored", [False, True])
def test_edit_distance(anchored):
    draw = np.random.default_rng(3)
    for _ in range(100):
        a, b = (draw.integers(0, 4, draw.integers(1, 9)).astype(np.uint64) for _ in range(2))
        ends = dc._semi_global(a, b, anchored)
        if not anchored:
            assert ends.min() == distance(a.tolist(), b.tolist())
        else:
            assert ends[-1] >= distance(a.tolist(), b.tolist())


def test_recall_at_the_full_share_by_length():
    """Items of any length with exactly a fifth of their words edited."""
    draw = random.Random(8)
    for length in (24, 25, 60, 100, 200, 400):
        items = [(i, " ".join(f"i{i}w{draw.randrange(10**6)}" for _ in range(length))) for i in range(40)]
        texts = []
        for _, item in items:
            leak = edited(draw, item.split(), length // 5)
            around = [[f"x{draw.randrange(10**6)}" for _ in range(50)] for _ in range(2)]
            texts.append(" ".join([*around[0], *leak, *around[1]]).encode())
        got = {(text, item) for text, item, *_ in dc.ItemIndex(items).matches(texts)}
        assert got <= {(i, i) for i in range(40)}
        assert len(got) >= 38, length


def test_item_several_times_in_a_row():
    item = " ".join(f"w{i}" for i in range(30))
    edited_item = item.replace("w3 ", "").replace("w20", "other")
    text = " ".join(["before", item, item, edited_item, "between", item, "after"])
    found = sorted(dc.ItemIndex([(1, item)]).matches([text.encode(), item.encode()]))
    spans = [(1, 31, 0), (31, 61, 0), (61, 90, 2), (91, 121, 0)]
    assert found == [*((0, 1, *s) for s in spans), (1, 1, 0, 30, 0)]


def test_tables_follow_from_the_recall():
    """More edits need more tables, and a share that no number of them serves is refused."""
    assert dc.tables_for(24, 0) == dc.LEAST_TABLES <= dc.tables_for(24, 4) < dc.tables_for(24, 7)
    assert dc.tables_for(20, 4, recall=0.9) < dc.tables_for(20, 4, recall=0.995)
    with pytest.raises(ValueError):
        dc.ItemIndex([(1, sentence(1, 24))], share=0.6)


def test_recall_at_a_larger_share():
    """A caller's share of 0.28, for which the tables are counted anew."""
    draw = random.Random(9)
    items = [(i, " ".join(f"i{i}w{draw.randrange(10**6)}" for _ in range(24))) for i in range(60)]
    texts = []
    for _, item in items:
        around = [[f"x{draw.randrange(10**6)}" for _ in range(30)] for _ in range(2)]
        texts.append(" ".join([*around[0], *edited(draw, item.split(), 6), *around[1]]).encode())
    got = {(text, item) for text, item, *_ in dc.ItemIndex(items, share=0.28).matches(texts)}
    assert len(got & {(i, i) for i in range(60)}) >= 57
