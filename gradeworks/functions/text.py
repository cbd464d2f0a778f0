"""Text expressions with the meaning Python gives them, as built-in Spark columns."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.strip() removes; none lies above U+3000.
PYTHON_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def literal_pattern(text: str) -> str:
    """Regular expression that matches ``text`` itself (Java dialect)."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def python_strip(text: Column) -> Column:
    """``str.strip()``: all Unicode white space at both ends, inner space kept."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def rstrip_newlines(text: Column) -> Column:
    """Text without its trailing newlines."""
    return F.rtrim(text, F.lit("\n"))


def extract_code(text: Column) -> Column:
    """Bodies of all python fences joined by newline, else of all fences, else ``''``."""
    tagged = F.regexp_extract_all(text, F.lit("(?s)```python(.*?)```"), F.lit(1))
    plain = F.regexp_extract_all(text, F.lit("(?s)```(.*?)```"), F.lit(1))
    return (
        F.when(text.isNull(), F.lit(None))
        .when(~text.contains("```"), F.lit(""))
        .when(F.size(tagged) > 0, F.array_join(tagged, "\n"))
        .otherwise(F.array_join(plain, "\n"))
    )


def is_integer_text(text: Column) -> Column:
    """True where Python's ``int(text)`` would succeed.

    One run of digits and underscores is matched without a repeated group, which would
    recurse on a long text; where underscores may stand is tested apart.
    """
    digits = F.regexp_replace(python_strip(text), r"\A[+-]", "")
    misplaced = digits.startswith("_") | digits.endswith("_") | digits.contains("__")
    return digits.rlike(r"(?U)\A[\d_]+\z") & ~misplaced


# The search runs back from the end of the text to where its last run of digits begins.
LAST_INTEGER = r"(?s)\A.*(?<!\p{Nd})(\p{Nd}+)"


def last_integer(text: Column) -> Column:
    """Last run of digits in the text, ``''`` if there is none."""
    return F.regexp_extract(text, LAST_INTEGER, 1)


def only_last_integer(text: Column) -> Column:
    """Last run of digits in the text, the text itself if there is none."""
    return F.regexp_replace(text, LAST_INTEGER + r".*\z", "$1")


def line_count(text: Column) -> Column:
    """Number of lines; a final newline opens no further line."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    closed = (text == "") | text.endswith("\n")
    return breaks + F.when(closed, 0).otherwise(1)
