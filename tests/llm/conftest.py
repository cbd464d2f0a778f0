import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns of the operators' own results, which a table may have as well.
CLASHES = ", n_lines long, fp long, ids binary, row long, anchor long, shard int, rejected boolean, doc string"

PARTS = ["alpha", "Beta,", "gamma.", "delta", "ÉPSILON", "zeta!", "it's", "1234", "the", "of", "naïve", "日本語", "ΣΑΣ", "x"]


def sentence(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(PARTS) + draw.choice(["", "", "s", "ing"]) for _ in range(words))


def edge_rows() -> list[tuple]:
    """Null ids and texts, empty and long texts, ties, repeated rows, odd white space, special strings."""
    shared = sentence(1, 60)
    texts = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "\n\n",
        "one",
        "<|endoftext|>",
        "a <|startoftext|>b<|endoftext|> c|d",
        "tabs\tand\r\nreturns \n  spaces  ",
        "To " * 400,
        "no break   \u0085 \x1c \x1f marks é ﬁ",
        "emoji \U0001f600\U0001f468‍\U0001f469 \x00 nul",
        "12345 67 8.9 !!! ??? don't we'll I'M",
        sentence(2, 30_000),
        shared,
        shared,
        shared.upper(),
        sentence(3, 20) + "\n" + shared + "\n" + sentence(4, 25),
        sentence(5, 3) + "\n" + shared + " " + sentence(6, 40),
    ]
    rows = [(i, text, ["en", "fr", None][i % 3], "src0", 7) for i, text in enumerate(texts)]
    rows += [rows[13], rows[13], rows[0]]
    rows += [(None, "line of a null id", None, None, None), (None, None, None, None, None)]
    rows += [(100 + i, f"same line\n  SAME line \nown {i} {sentence(i, 9)}", "en", "src1", 5) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def edge_folder(spark, tmp_path_factory):
    """A folder of tables whose documents are the edge rows, with clashing extra columns."""
    folder = str(tmp_path_factory.mktemp("edge"))
    clash = (1, 2, b"3", 4, 5, 6, True, "7")
    rows = spark.createDataFrame([(*r, *clash) for r in edge_rows()], DOCUMENTS + CLASHES)
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    return folder


@pytest.fixture
def documents(spark, tmp_path):
    """Writes documents of (doc_id, text) and gives their folder."""

    def write(rows):
        full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        spark.createDataFrame(full, DOCUMENTS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write
