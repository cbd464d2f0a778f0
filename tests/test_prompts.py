"""Prompts and conversation text."""

import pytest
from pyspark.sql import functions as F

from gradeworks import fixed_values as X
from gradeworks.functions.prompts import render_messages, render_template
from gradeworks.operators import prompts as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_templates(spark):
    text = value(spark, render_template("{a} {{x}} {b}{a}", {"a": F.lit("1"), "b": F.lit("{2}")}))
    assert text == "1 {x} {2}1"
    with pytest.raises(ValueError, match="program_output"):
        render_template(X.RESULT_EXTRACTION, {})
    filled = value(spark, P.result_extraction_prompt(F.lit("12")))
    assert filled == X.RESULT_EXTRACTION.format(program_output="12")
    math = value(spark, P.math_prompt(F.lit("T"), F.lit("D")))
    assert math == X.MATH_INSTRUCTION.format(title="T", description="D")


def test_conversion_shows_the_start_of_the_input(spark):
    args = [F.lit(v) for v in ("ex", "p1", "p2", "i" * 80)]
    text = value(spark, P.conversion_prompt(*args))
    assert "i" * 50 + "\n" in text and "i" * 51 not in text


def test_part1_instruction_can_carry_the_description(spark):
    assert value(spark, P.part1_instruction(F.lit("D"))) == X.PART1_INSTRUCTION
    assert value(spark, P.part1_instruction(F.lit("D"), True)).endswith("\n\nD")


def test_chat_messages(spark):
    one = value(spark, P.chat_part1(F.lit("D")))
    assert [(m.role, m.text) for m in one] == [("system", X.SYSTEM_MESSAGE), ("human", "D")]
    history = P.pass_history(F.lit("D"), F.lit("R"))
    two = value(spark, P.chat_part2(history))
    assert [m.role for m in two] == ["system", "human", "ai", "human"]
    assert two[-1].text == X.PART2_INSTRUCTION
    assert value(spark, P.chat_part2(history, F.lit("D2")))[-1].text.endswith("\n\nD2")
    again = value(spark, render_messages(P.chat_part1(F.lit("E"), history)))
    assert again.startswith("human: D\nai: R\nsystem: ")


def test_part2_continues_the_last_executed_pass(frame):
    generations = frame([(1, "D", "first"), (2, "D", "second")],
                        "row_no long, description string, response string")
    rows = [("m", 3, "no_error", 2), ("m", 25, "no_error", 1), ("m", 4, "wrong_output", 1), ("m", 5, None, 1)]
    chosen = frame(rows, "model string, day int, status string, row_no long")
    found = P.part2_prompts(chosen, generations).collect()
    assert [[m.text for m in row.messages][1:3] for row in found] == [["D", "second"]]


def test_conversations_are_whole(frame):
    rows = [(1, t, "user", f"x{t}") for t in range(200)] + [(1, 5, "user", "x5"), (1, None, "system", "s")]
    rows.append((2, 0, "ai", "y"))
    found = P.conversation_text(frame(rows, "conv_id int, turn int, role string, text string"))
    texts = {r.conv_id: (r.turns, r.prompt) for r in found.collect()}
    turns = sorted([*range(200), 5])
    assert texts == {
        1: (202, "\n".join(["system: s", *(f"user: x{t}" for t in turns)])),
        2: (1, "ai: y"),
    }
