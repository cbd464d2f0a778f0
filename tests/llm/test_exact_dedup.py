"""Exact dedup against a dictionary of normalised texts, and the perfect hash on its own."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from gradeworks.llm import common
from gradeworks.llm import exact_dedup as D
from llm.support import in_order, read_rows

NAMES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", text or ""), []).append(doc_id)
    found = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        found += [(i, ids[0], len(ids), place == 0, sha) for place, i in enumerate(ids)]
    return found


def run(spark, folder):
    return [tuple(r) for r in D.op12_exact_dedup(spark, folder).select(*NAMES).collect()]


def test_edge_rows(spark, edge_folder):
    assert in_order(run(spark, edge_folder)) == in_order(plain(read_rows(edge_folder)))


def test_given_documents_and_sql(spark):
    found = in_order(run(spark, SMALL))
    assert found == in_order(plain(read_rows(SMALL)))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert found == in_order(connection.execute(f"SELECT {', '.join(NAMES)} FROM ({D.OP12_SQL})").fetchall())


def test_empty_table(spark, empty_folder):
    assert run(spark, empty_folder) == []


def test_hot_text_goes_to_many_pieces(spark, documents, monkeypatch):
    monkeypatch.setattr(common, "PIECE_ROWS", 50)
    monkeypatch.setattr(D, "SHARD_DIGESTS", 64)
    rows = [(i, "the  same text" if i % 3 else f"own {i // 2}") for i in range(900)]
    rows += [(5, "the same\ttext")] * 4 + [(None, "the same text"), (None, "only null"), (None, "only  null")]
    assert in_order(run(spark, documents(rows))) == in_order(plain(rows))


def test_pieces_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    monkeypatch.setattr(common, "PIECE_ROWS", 20)
    monkeypatch.setattr(common, "SENT_SHARDS", 0)
    rows = [(i, f"text {i % 7}") for i in range(200)]
    assert in_order(run(spark, documents(rows))) == in_order(plain(rows))


@pytest.mark.parametrize("history", ["true", "false", "doc_id > 60"])
def test_any_history_gives_the_same_winners(spark, documents, history):
    rows = [(i, f"text {i % 40}") for i in range(120)]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    found = D.decide(D.digest_table(docs), F.expr(history)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == sorted(r[:4] for r in plain(rows))


def test_whole_documents_are_kept(spark, edge_folder):
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    kept = D.distinct_documents(docs)
    assert kept.columns == docs.columns
    wanted = [r[0] for r in plain(read_rows(edge_folder)) if r[3]]
    assert in_order((r.doc_id,) for r in kept.collect()) == in_order((i,) for i in wanted)


def test_perfect_hash():
    digests = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    table = D.PerfectHash.of(digests)
    assert sorted(table.slots(digests)) == list(range(5000))
    # Digests that differ in their last bytes only, and one that is no member.
    near = np.repeat(digests[:1], 300, axis=0)
    near[:, 3] = np.arange(300)
    assert len(set(D.PerfectHash.of(near).slots(near).tolist())) == 300
    with pytest.raises(ValueError):
        D.PerfectHash.of(np.repeat(digests[:1], 2, axis=0))


def test_a_slot_is_compared_byte_by_byte(spark):
    """A digest that lands on another's slot is no member."""
    held = [(bytes([i]) * 32, i, i, 1) for i in range(50)]
    index = D.build_index(spark.createDataFrame(held, "digest binary, keep_id long, keep_row long, n long"), 1)
    asked = [(bytes([i]) * 31 + b"\xff", 500 + i, 500 + i) for i in range(50)] + [(bytes([7]) * 32, 9, 9)]
    rows = spark.createDataFrame(asked, "digest binary, doc_id long, row long")
    members = D.look_up(rows, index, 1).where("keep_row IS NOT NULL").collect()
    assert [(r.doc_id, r.keep_id) for r in members] == [(9, 7)]
