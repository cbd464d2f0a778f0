import hashlib
from collections import Counter

import numpy as np
import pytest

from gradeworks.llm import common
from gradeworks.llm import line_dedup as ld
from llm.support import in_order, read_rows

SMALL = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def expected(rows, least=10):
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        yield doc_id, len(lines), len(lines) - len(kept), digest


@pytest.mark.parametrize("where", ["edge", "small"])
def test_rows(spark, edge_folder, where):
    folder = edge_folder if where == "edge" else SMALL
    found = ld.op1_line_dedup(spark, folder)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert in_order(found.collect()) == in_order(expected(read_rows(folder)))


def test_empty_table(spark, empty_folder):
    assert ld.op1_line_dedup(spark, empty_folder).collect() == []


def test_agrees_with_sql(spark, tables):
    assert in_order(ld.op1_line_dedup(spark, SMALL).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == in_order(
        tables.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ld.OP1_SQL})").fetchall()
    )


def test_deletion_undoes_insertion(spark):
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, more = frame(["a\nb", "a", "a\nc"]), frame(["a\nb", "b\nd", "b"])
    before = ld.count_lines(first)
    after = ld.add_documents(before, more)
    assert in_order(ld.remove_documents(after, more).collect()) == in_order(before.collect())
    filters = ld.build_filters(before, 3, 2)
    grown = ld.update_filters(filters, before, after, 3, 2)
    assert {r.text for r in ld.drop_lines(first, after, grown, 3, 2).collect()} == {"", "c"}
    back = ld.update_filters(grown, after, before, 3, 2)
    assert {r.text for r in ld.drop_lines(first, before, back, 3, 2).collect()} == {"b", "", "c"}


@pytest.mark.parametrize("piece", [1 << 17, 20])
def test_filters_serve_beyond_the_broadcast_bound(spark, edge_folder, monkeypatch, piece):
    """Lines meet their shard's filter in the tasks; a hot shard in several pieces."""
    monkeypatch.setattr(ld, "FILTER_BYTES", -1)
    monkeypatch.setattr(common, "PIECE_ROWS", piece)
    found = ld.op1_line_dedup(spark, edge_folder).collect()
    assert in_order(found) == in_order(expected(read_rows(edge_folder)))


def test_filters_beyond_the_bound_leave_lines_out(spark, edge_folder, monkeypatch):
    """Hardly any line but the finds gets past the filters on its way to the exact table."""
    monkeypatch.setattr(ld, "FILTER_BYTES", -1)
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet").select("text").na.fill("")
    counts = ld.count_lines(docs)
    shards = ld.shard_count(counts, 10)
    left = ld._finds(docs, ld.build_filters(counts, 10, shards), shards)
    frequent = counts.where("n_docs >= 10").select("hi", "lo")
    assert 0 < left.count() <= left.join(frequent, ["hi", "lo"], "left_semi").count() + 2


def test_filter_insert_delete():
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 1 << 63, 2000, dtype=np.uint64)
    others = draw.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    made = ld.CuckooFilter(len(keys))
    assert made.insert(keys) and made.contains(keys).all()
    assert made.contains(others).mean() < 0.002
    made.delete(keys[:1000])
    again = ld.CuckooFilter(table=made.to_bytes())
    assert again.contains(keys[1000:]).all() and again.contains(keys[:1000]).mean() < 0.01


def test_full_filter_is_reported():
    small = ld.CuckooFilter(1)
    assert not small.insert(np.random.default_rng(2).integers(0, 1 << 63, 500, dtype=np.uint64))
