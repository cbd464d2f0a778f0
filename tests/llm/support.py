"""Helpers of the operators' tests."""

import zlib


def read_rows(folder: str) -> list[tuple]:
    """(doc_id, text) of a folder's documents, read without the engine."""
    import pyarrow.dataset as ds

    table = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"])
    return [(r["doc_id"], r["text"]) for r in table.to_pylist()]


def order(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


def in_order(rows) -> list[tuple]:
    """Rows as tuples in one order, nulls first."""
    return sorted((tuple(r) for r in rows), key=order)


def fold(doc_id, folds: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def words_of(text) -> list[bytes]:
    return (text or "").encode().split()
