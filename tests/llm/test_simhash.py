import random

import pytest
import xxhash

from gradeworks.llm import simhash
from gradeworks.llm.components import component_of
from llm.support import in_order, order, read_rows, words_of

SMALL = "/root/testdata/sf0.001"


def fingerprint(text, each=4):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + each]) for i in range(max(1, len(words) - each + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, radius=4):
    """The number of the first member of each one's group."""
    first = list(range(len(prints)))

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                one, two = root(i), root(j)
                first[max(one, two)] = min(one, two)
    return [root(i) for i in range(len(prints))]


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    of = groups(prints)
    smallest = {}
    for (i, _), g in zip(rows, of, strict=True):
        smallest[g] = min((x for x in (smallest.get(g), i) if x is not None), default=None)
    return [(i, f"{p:016x}", smallest[g]) for (i, _), p, g in zip(rows, prints, of, strict=True)]


@pytest.mark.parametrize("where", ["edge", "small"])
def test_rows(spark, edge_folder, where):
    folder = edge_folder if where == "edge" else SMALL
    found = simhash.op9_simhash(spark, folder)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert in_order(found.collect()) == in_order(expected(read_rows(folder)))


def test_empty_table(spark, empty_folder):
    assert simhash.op9_simhash(spark, empty_folder).collect() == []


def test_one_of_each(spark, edge_folder):
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    components = [c for *_, c in expected(read_rows(edge_folder))]
    assert [order((r.doc_id,)) for r in sorted(kept.collect(), key=lambda r: order((r.doc_id,)))] == sorted(
        order((c,)) for c in set(components)
    )


def _links(spark, numbers, radius):
    frame = spark.createDataFrame([(n - (1 << 64) if n >> 63 else n,) for n in numbers], "fp long")
    links = simhash.fingerprint_links(frame, radius)
    found = component_of(links)
    return {r.node % (1 << 64): r.root % (1 << 64) for r in found.collect()}, links.count()


@pytest.mark.parametrize("piece", [8192, 7])
def test_links_in_crowded_shards(spark, monkeypatch, piece):
    """A dense group of fingerprints, whole and cut into pieces, spans without all of its pairs."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(3)]
    numbers = sorted({c ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for c in centres for _ in range(40)})
    numbers += [draw.getrandbits(64) for _ in range(60)]
    roots, count = _links(spark, numbers, 4)
    found = [roots.get(n, n) for n in numbers]
    want = groups(numbers)
    assert len(set(zip(found, want, strict=True))) == len(set(found)) == len(set(want))
    assert count < 5 * len(numbers) * (1 if piece > 100 else 20)


def test_tree_finds_all_within():
    draw = random.Random(4)
    numbers = {draw.getrandbits(64) & 0xFFF for _ in range(300)}
    tree = simhash.BKTree()
    for n in numbers:
        tree.add(n)
        tree.add(n)
    for n in range(0, 4096, 37):
        assert sorted(tree.within(n, 2)) == sorted(m for m in numbers if (m ^ n).bit_count() <= 2)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (900, 901)], "a long, b long")
    roots = {r.node: r.root for r in component_of(links).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[900] == roots[901] != roots[0]


@pytest.mark.parametrize("at_most", [10, 10**9, 10**11, 10**14])
def test_more_blocks_find_the_same_components(spark, at_most):
    """What decides the number of blocks does not decide what is found."""
    draw = random.Random(12)
    numbers = set()
    for _ in range(40):
        number = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 8)):
            numbers.add(number)
            for _ in range(draw.randrange(1, 6)):
                number ^= 1 << draw.randrange(64)
    numbers = sorted(numbers)
    frame = spark.createDataFrame([(n - (1 << 64) if n >> 63 else n,) for n in numbers], "fp long")
    found = {r.node % (1 << 64): r.root for r in component_of(simhash.fingerprint_links(frame, 4, at_most)).collect()}
    of = groups(numbers)
    together = {}
    for number, group in zip(numbers, of, strict=True):
        together.setdefault(group, set()).add(number)
    for members in together.values():
        if len(members) > 1:
            assert len({found[m] for m in members}) == 1
    assert len(set(found.values())) == sum(len(m) > 1 for m in together.values())


def test_blocks_follow_the_fingerprints():
    assert [simhash.block_count(n, 4) for n in (0, 10**6, 3 * 10**7, 10**9, 10**10)] == [5, 5, 5, 6, 6]
