import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeworks.llm import substring_dedup as sd
from llm.support import in_order, order, read_rows, words_of

SMALL = "/root/testdata/sf0.001"


def expected(rows, width=20):
    """Windows seen in the order of ids; rows of one id and text are one document."""
    seen, result = {}, []
    done = {}
    for doc_id, text in sorted(rows, key=lambda r: order((r[0],))):
        words = words_of(text)
        gone = [False] * len(words)
        if (doc_id, text or "") not in done:
            for i in range(len(words) - width + 1):
                window = tuple(words[i : i + width])
                if window in seen:
                    gone[i : i + width] = [True] * width
                seen.setdefault(window, 1)
            done[doc_id, text or ""] = gone
        gone = done[doc_id, text or ""]
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        result.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return result


@pytest.mark.parametrize("where", ["edge", "small"])
def test_rows(spark, edge_folder, where):
    folder = edge_folder if where == "edge" else SMALL
    found = sd.op7_substring_dedup(spark, folder)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert in_order(found.collect()) == in_order(expected(read_rows(folder)))


def test_empty_table(spark, empty_folder):
    assert sd.op7_substring_dedup(spark, empty_folder).collect() == []


@pytest.mark.parametrize("contents", [5_000, 1])
def test_repeats_of_all_kinds(spark, documents, monkeypatch, contents):
    """Two-word texts repeat at every distance; passages stand in changing company."""
    monkeypatch.setattr(sd, "SHARD_CONTENTS", contents)
    draw = random.Random(5)
    passages = [" ".join(f"p{n}w{i}" for i in range(30)) for n in range(4)]
    rows = [(i, " ".join(draw.choice("ab") for _ in range(90))) for i in range(12)]
    for i in range(12, 40):
        own = [" ".join(f"own{draw.randrange(9)}" for _ in range(draw.randrange(6))) for _ in range(4)]
        rows.append((i, " ".join(own[:2] + [draw.choice(passages)] + own[2:] + [draw.choice(passages)])))
    folder = documents(rows)
    assert in_order(sd.op7_substring_dedup(spark, folder).collect()) == in_order(expected(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=25), max_size=5), st.text("abc", max_size=40))
def test_matching_statistics(known, text):
    automaton = sd.SuffixAutomaton()
    for one in known:
        automaton.add(list(one))
    for end, size in enumerate(automaton.matches(list(text)), 1):
        longest = max(n for n in range(end + 1) if n == 0 or any(text[end - n : end] in one for one in known))
        assert size == longest


def test_texts_of_one_id_with_alike_hashes(spark, documents):
    """Two texts of one id whose hashes have the first 31 bits in common keep their own spans."""
    passage = " ".join(f"w{i}" for i in range(30))
    long, short = "u9815 " + passage, "v9012 is short"
    hashes = spark.createDataFrame([(long,), (short,)], "text string").selectExpr("shiftrightunsigned(xxhash64(text), 33) AS h")
    assert hashes.distinct().count() == 1
    rows = [(None, passage), (7, long), (7, short)]
    folder = documents(rows)
    assert in_order(sd.op7_substring_dedup(spark, folder).collect()) == in_order(expected(rows))


def passages_in_company(seed, documents):
    draw = random.Random(seed)
    passages = [" ".join(f"p{n}w{i}" for i in range(30)) for n in range(6)]
    for i in range(documents):
        own = [" ".join(f"own{draw.randrange(400)}" for _ in range(draw.randrange(40))) for _ in range(4)]
        yield i, " ".join(own[:2] + [draw.choice(passages)] + own[2:] + [draw.choice(passages)])


def test_places_are_joined_where_no_map_would_be_empty_enough(spark, documents, monkeypatch):
    rows = [*passages_in_company(5, 60), (None, "a b " * 30), (3, None), (3, "")]
    rows += rows[:2]
    folder = documents(rows)
    monkeypatch.setattr(sd, "MAP_SHARE", 1 << 30)
    assert in_order(sd.op7_substring_dedup(spark, folder).collect()) == in_order(expected(rows))


@pytest.mark.parametrize("share", [32, 1 << 30])
def test_carried_words_stay_below_the_text(spark, monkeypatch, share):
    """Words are carried for the places asked for: all of them, and hardly another."""
    monkeypatch.setattr(sd, "MAP_SHARE", share)
    rows = list(passages_in_company(6, 200))
    docs = spark.createDataFrame([(i, i * 7, 0, t) for i, t in rows], "doc_id long, text_key long, text_key2 long, text string")
    places = spark.createDataFrame([(i, i * 7, s) for i, _ in rows for s in (0, 5)], "doc_id long, text_key long, start long")
    found = sd._words_at(docs, places, places.count(), 20).collect()
    texts = dict(rows)
    met = {(r.doc_id, r.start) for r in found}
    assert met >= {(i, s) for i, t in rows for s in (0, 5) if s < len(t.split())}
    assert all(r.words.decode().split() == texts[r.doc_id].split()[r.start : r.start + 30] for r in found)
    extra = len(met) - 2 * len(rows)
    assert extra <= (0 if share > 32 else 0.01 * sum(len(t.split()) for t in texts.values()))


def test_a_full_map_costs_no_correct_result(spark, documents, monkeypatch):
    """Maps of the least size for a corpus that fills much of them."""
    monkeypatch.setattr(sd, "LEAST_MAP_BITS", 16)
    monkeypatch.setattr(sd, "MOST_MAP_BITS", 16)
    rows = list(passages_in_company(7, 300))
    assert in_order(sd.op7_substring_dedup(spark, documents(rows)).collect()) == in_order(expected(rows))
