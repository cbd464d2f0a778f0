"""Text expressions against the Python behaviour they stand for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gradeworks.functions.numbers import round_one_decimal, shade_bucket, two_decimals
from gradeworks.functions.text import (
    extract_code,
    is_integer_text,
    last_integer,
    line_count,
    python_strip,
    rstrip_newlines,
)



def fenced(text, opening):
    """What stands between an opening and the next fence, from left to right."""
    bodies = []
    while (start := text.find(opening)) >= 0:
        rest = text[start + len(opening) :]
        end = rest.find("```")
        if end < 0:
            break
        bodies.append(rest[:end])
        text = rest[end + 3 :]
    return bodies


def test_extract_code(evaluate):
    cases = {
        "a ```python\nx=1\n``` b ```python\ny=2``` c": "\nx=1\n\n\ny=2",
        "```js\nx```": "js\nx",
        "no fence": "",
        "```python unclosed": "",
        "```plain``` then ```python\nz```": "\nz",
        "": "",
        "```python3\nq```": "3\nq",
    }
    assert evaluate(extract_code, list(cases)) == list(cases.values())
    assert evaluate(extract_code, [None]) == [None]


def test_extract_code_of_random_fences(evaluate):
    pieces = ["```", "```python", "\n", "x = 1", " ", "``", "`"]
    rng = random.Random(1)
    texts = ["".join(rng.choices(pieces, k=12)) for _ in range(300)]
    wanted = ["\n".join(fenced(t, "```python") or fenced(t, "```")) for t in texts]
    assert evaluate(extract_code, texts) == wanted


def test_a_long_integer_text_does_not_recurse(evaluate):
    texts = ["1" + "_1" * 20_000, "9" * 50_000, "1" + "_1" * 20_000 + "_", "_1", "1__1", "+1_0", "+-1", "+", "_", ""]
    assert evaluate(is_integer_text, texts) == [True, True, False, False, False, True, False, False, False, False]


def test_strip_removes_all_python_whitespace(evaluate):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [f"{s}{s} a{s}b {s}" for s in spaces] + ["".join(spaces), "", "\u200bx\u200b"]
    assert evaluate(python_strip, texts) == [t.strip() for t in texts]


def test_integer_text_is_what_int_accepts(evaluate):
    texts = ["5", " 5 ", "+5", "-3", "1_000", "1__0", "_1", "1_", "5.0", "1e3", "", "+", "٣",
             "５", "0x1f", "1 2", "- 3", "\n7\n", "²", "007"]

    def accepted(text):
        try:
            int(text)
        except ValueError:
            return False
        return True

    assert evaluate(is_integer_text, texts) == [accepted(t) for t in texts]


def test_last_integer(evaluate):
    rng = random.Random(2)
    texts = ["".join(rng.choices("0123 a\n.-٣", k=9)) for _ in range(300)] + ["", "x", "1" * 5000]
    expected = [(re.findall(r"\d+", t) or [""])[-1] for t in texts]
    assert evaluate(last_integer, texts) == expected


def test_rstrip_newlines_and_line_count(evaluate):
    texts = ["a\n\n", "a\nb", "\n", "", "a \n ", "\r\n"]
    assert evaluate(rstrip_newlines, texts) == [t.rstrip("\n") for t in texts]
    lines = [len(t[:-1].split("\n")) if t.endswith("\n") else len(t.split("\n")) for t in texts]
    lines = [0 if t == "" else n for t, n in zip(texts, lines)]
    assert evaluate(line_count, texts) == lines


def test_rounding(spark):
    pd = pytest.importorskip("pandas")
    values = [0.05, 0.25, 0.35, 12.25, 33.35, 66.65, 0.0, 100.0, 2.675, 0.125]
    rows = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    found = rows.select(
        round_one_decimal(F.col("v")).alias("one"),
        two_decimals(F.col("v")).alias("two"),
        shade_bucket(F.col("v")).alias("shade"),
    ).collect()
    assert [r.one for r in found] == pd.Series(values).round(1).tolist()
    assert [r.two for r in found] == [f"{v:.2f}" for v in values]
    assert [r.shade for r in found] == [int(v // 5) for v in values]
