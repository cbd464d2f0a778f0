"""Cleaning of raw puzzle documents, by searching for places in their text.

A text is never taken apart into lines: sections are cut at the places of their marker words, and
lines that hold a word are left out by cutting around its places, where there are any. A line ends with its newline;
the last one may lack it.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeworks.fixed_values import (
    ANSWER_PHRASE,
    LINK_WORD,
    PART1_HEADER,
    PART2_HEADER,
    PART2_MARKER,
    STOP_PHRASE,
)
from gradeworks.functions.text import literal_pattern, rstrip_newlines

NEWLINE = "\n"


def in_steps(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """The value after all steps, each applied to the result of the one before.

    A one-element array carries the value. A step may so read its input several times
    while the expression, and the work on a long text, stays linear, wherever the optimizer
    moves it.
    """
    carried = F.array(value)
    for step in steps:
        carried = F.transform(carried, step)
    return F.element_at(carried, 1)


def _behind(text: Column, start: Column, more: int = 0) -> Column:
    """The text without what it starts with, and some bytes more; places in bytes need no count of letters."""
    return F.substr(text.cast("binary"), F.octet_length(start) + 1 + more).cast("string")


def _in_front(text: Column, end: Column) -> Column:
    """The text without what it ends with."""
    size = F.octet_length(text) - F.octet_length(end)
    return F.substr(text.cast("binary"), F.lit(1), size).cast("string")


def _without_lines(text: Column, word: str) -> Column:
    """The lines without those that hold the word: what lies between its places, in whole lines."""

    def whole_lines(pieces: Column) -> Column:
        last = F.size(pieces) - 1

        def inner(piece: Column, i: Column) -> Column:
            opened = F.when(i > 0, _behind(piece, F.substring_index(piece, NEWLINE, 1), 1)).otherwise(piece)
            closed = _in_front(opened, F.substring_index(opened, NEWLINE, -1))
            return F.when(i < last, closed).otherwise(opened)

        return F.array_join(F.transform(pieces, inner), "")

    removed = in_steps(F.split(text, literal_pattern(word)), whole_lines)
    return F.when(text.contains(word), removed).otherwise(text)


def _lines_before(text: Column, word: str) -> Column:
    """The lines in front of the first one that holds the word, all lines if none does."""
    before = F.substring_index(text, word, 1)
    begun = F.substring_index(before, NEWLINE, -1)
    return F.when(text.contains(word), _in_front(before, begun)).otherwise(text)


def _without_outer_blanks(text: Column) -> Column:
    """The lines without a blank first line and a blank last line."""
    newline = F.lit(NEWLINE)
    text = F.when(text.startswith(NEWLINE), _behind(text, newline)).otherwise(text)
    blank_end = (text == NEWLINE) | text.endswith(NEWLINE + NEWLINE)
    return F.when(blank_end, _in_front(text, newline)).otherwise(text)


def with_plain_line_ends(text: Column) -> Column:
    """The text with ``\\r\\n`` and a lone ``\\r`` as newlines, as text files are read."""
    newline = F.lit(NEWLINE)
    plain = F.replace(F.replace(text, F.lit("\r\n"), newline), F.lit("\r"), newline)
    return F.when(text.contains("\r"), plain).otherwise(text)


def clean_section(
    text: Column,
    header: str,
    keep_header: bool,
    link_word: str = LINK_WORD,
    stop_phrase: str = STOP_PHRASE,
) -> Column:
    """Text of a section: from its header line to the answer line, without link lines.

    A kept header line is spared from both tests. One blank line at each end is dropped.
    Without a header, or with nothing left, the text is ``''``.
    """
    begin = NEWLINE + header

    def from_header(plain: Column) -> Column:
        opened = F.concat(F.lit(NEWLINE), plain)
        before = F.substring_index(opened, begin, 1)
        section = _behind(opened, before, 1)
        return F.when(opened.contains(begin), section).otherwise(F.lit(""))

    def parted(section: Column) -> Column:
        line = F.substring_index(section, NEWLINE, 1)
        rest = _behind(section, line)
        return F.struct(line.alias("head"), rest.alias("rest"))

    def body(found: Column) -> Column:
        # The newline that ends the header line belongs to it.
        return F.struct(
            F.concat(found["head"], F.left(found["rest"], F.lit(1))).alias("head"),
            _without_lines(_behind(found["rest"], F.lit(NEWLINE)), link_word).alias("body"),
        )

    def cut(found: Column) -> Column:
        kept = _lines_before(found["body"], stop_phrase)
        return F.concat(found["head"], kept) if keep_header else kept

    steps = [with_plain_line_ends, from_header, parted, body, cut]
    return in_steps(text, *steps, _without_outer_blanks)


def clean_part1(text: Column, header: str = PART1_HEADER, **words: str) -> Column:
    """Part 1 of a raw text: it starts with its header line."""
    return clean_section(text, header, True, **words)


def clean_part2(text: Column, header: str = PART2_HEADER, **words: str) -> Column:
    """Part 2 of a raw text: it starts after the rule line."""
    return clean_section(text, header, False, **words)


def part_texts(text: Column, marker: str = PART2_MARKER) -> Column:
    """Lines in front of and behind the marker line, as a struct (part1, part2) of texts.

    Further marker lines are left out, and a last line gets its newline. A part without lines is
    empty.
    """

    def closed(raw: Column) -> Column:
        ended = (raw == "") | raw.endswith(NEWLINE)
        return F.when(ended, raw).otherwise(F.concat(raw, F.lit(NEWLINE)))

    def parted(whole: Column) -> Column:
        return F.struct(whole.alias("whole"), _lines_before(whole, marker).alias("part1"))

    def shared(found: Column) -> Column:
        rest = _behind(found["whole"], found["part1"])
        return F.struct(found["part1"].alias("part1"), _without_lines(rest, marker).alias("part2"))

    return in_steps(text, closed, parted, shared)


def extract_answer(text: Column, phrase: str = ANSWER_PHRASE) -> Column:
    """Answers named in a text, one per line: lines with the phrase, less its first place, ticks and dots."""

    def named(pieces: Column) -> Column:
        """The lines around the phrase's places; a further place in one line stays in it."""

        def around(piece: Column, i: Column) -> Column:
            before = F.get(pieces, i)
            begun = F.substring_index(before, NEWLINE, -1)
            begin = F.when((i == 0) | before.contains(NEWLINE), begun).otherwise(F.lit(phrase))
            rest = F.substring_index(piece, NEWLINE, 1)
            return F.concat(begin, rest, F.when(piece.contains(NEWLINE), F.lit(NEWLINE)).otherwise(F.lit("")))

        behind = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        return F.array_join(F.transform(behind, around), "")

    found = in_steps(F.split(text, literal_pattern(phrase)), named)
    lines = F.when(text.contains(phrase), found).otherwise(F.left(text, F.lit(0)))
    return rstrip_newlines(F.translate(lines, "`.", ""))
