"""The pipeline against plain versions of its stages, each on what the stage before kept."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gradeworks.llm import bpe, language_id
from llm.support import in_order, order
from llm.test_decontamination import brute
from llm.test_line_dedup import key
from llm.test_simhash import expected as near

SMALL = "/root/testdata/sf0.001"


def plain(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rejected = language_id.fit(frame).predict([t for _, t, _ in docs])["rejected"]
    rows = [(i, t) for (i, t, _), gone in zip(docs, rejected, strict=True) if not gone]
    lines = [[key(x) for x in t.split("\n")] for _, t in rows]
    found = {}
    for own in lines:
        for k in set(own) - {""}:
            found[k] = found.get(k, 0) + 1
    rows = [
        (i, "\n".join(x for x, k in zip(t.split("\n"), own, strict=True) if found.get(k, 0) < 10))
        for (i, t), own in zip(rows, lines, strict=True)
    ]
    # rows of one id are copies of one another here
    kept = {i: t for (i, t), (_, _, c) in zip(rows, near(rows), strict=True) if i == c}
    leaks = {d for d, *_ in brute(kept.items(), items)}
    made = Tokenizer.from_file(bpe.TOKENIZER)
    for i, t in kept.items():
        if i not in leaks:
            ids = made.encode(t, add_special_tokens=False).ids
            decoded = made.decode(ids, skip_special_tokens=False)
            yield i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("where", ["edge", "small"])
def test_rows(spark, edge_folder, tmp_path, where):
    folder = edge_folder if where == "edge" else SMALL
    if where == "edge":
        bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
        bench.write.mode("overwrite").parquet(f"{edge_folder}/benchmark.parquet")
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, folder)
    assert in_order(found.collect()) == in_order(plain(spark, docs, items))


def test_stages_keep_the_columns(spark, edge_folder):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bench.write.mode("overwrite").parquet(f"{edge_folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "line_dedup", "near_dedup", "decontamination", "encoding"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, edge_folder)
        assert left.dtypes == docs.dtypes
        ids = {order((r.doc_id,)) for r in left.select("doc_id").collect()}
        assert ids and ids <= {order((r.doc_id,)) for r in docs.collect()}


def test_empty_tables(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).collect() == []
