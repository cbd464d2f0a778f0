"""Prompts as columns: a template's placeholders are filled from expressions."""

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def render_template(template: str, values: Mapping[str, Column]) -> Column:
    """The template with each named placeholder replaced by its column.

    A placeholder without a column is an error at build time, before any job starts.
    """
    pieces = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is None:
            continue
        if name not in values:
            raise ValueError(f"no column for placeholder {{{name}}}")
        pieces.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def message(role: str | Column, text: str | Column) -> Column:
    """One chat message."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(as_column(role).alias("role"), as_column(text).alias("text"))


def told(role: Column, text: Column) -> Column:
    """A message as ``role: text``; an absent part is empty, so that the message itself stays."""
    return F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def render_messages(messages: Column) -> Column:
    """A message list as text, one ``role: text`` block per message."""
    return F.array_join(F.transform(messages, lambda m: told(m["role"], m["text"])), "\n")
