"""Prompts of a run, and the chat history that part 2 continues."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.fixed_values import (
    CONVERSION,
    LAST_DAY,
    MATH_INSTRUCTION,
    NO_ERROR,
    PART1_INSTRUCTION,
    PART2_INSTRUCTION,
    RESULT_EXTRACTION,
    SAMPLE_INPUT_CHARS,
    SYSTEM_MESSAGE,
)
from gradeworks.functions.prompts import message, render_template, told
from gradeworks.operators.hotkeys import sent_if_sparse


def math_prompt(title: Column, description: Column) -> Column:
    """Instruction prompt of a math problem."""
    return render_template(MATH_INSTRUCTION, {"title": title, "description": description})


def part1_instruction(description: Column, include_description: bool = False) -> Column:
    """Instruction-only prompt of part 1; its wording has no place for the description."""
    prompt = F.lit(PART1_INSTRUCTION)
    return F.concat(prompt, F.lit("\n\n"), description) if include_description else prompt


def result_extraction_prompt(program_output: Column) -> Column:
    """Prompt that asks for the bare result of a program output."""
    return render_template(RESULT_EXTRACTION, {"program_output": program_output})


def conversion_prompt(example: Column, part1: Column, part2: Column, text: Column) -> Column:
    """Prompt that turns a story into a neutral task; shows the start of the input."""
    return render_template(
        CONVERSION,
        {
            "converted_challenges": example,
            "story_part1": part1,
            "story_part2": part2,
            "sample_input": F.substring(text, 1, SAMPLE_INPUT_CHARS),
        },
    )


def chat_part1(description: Column, history: Column | None = None) -> Column:
    """Messages of part 1: history, system message, description."""
    opening = F.array(message("system", SYSTEM_MESSAGE), message("human", description))
    return opening if history is None else F.concat(history, opening)


def chat_part2(history: Column, description: Column | None = None) -> Column:
    """Messages of part 2: system message, history of part 1, part-2 instruction.

    The instruction has no place for the part-2 text; give ``description`` to add it.
    """
    closing = F.lit(PART2_INSTRUCTION)
    if description is not None:
        closing = F.concat(closing, F.lit("\n\n"), description)
    return F.concat(
        F.array(message("system", SYSTEM_MESSAGE)), history, F.array(message("human", closing))
    )


def pass_history(description: Column, response: Column) -> Column:
    """History of one executed pass: what was asked and what came back."""
    return F.array(message("human", description), message("ai", response))


def part2_prompts(part1_results: DataFrame, generations: DataFrame) -> DataFrame:
    """Part-2 messages of each task, continuing the last executed pass of part 1.

    Part 2 is attempted where part 1 was solved, on every day but the last.
    ``part1_results`` has day and status and names that pass by ``row_no`` (``best_of_k``);
    ``generations`` has row_no, description and response. The match is on a unique number,
    and a history is two columns of one row, so nothing is gathered per task; the due numbers go to
    the responses where their size allows it, and no response is shuffled.
    """
    due = part1_results.where((F.col("status") == NO_ERROR) & (F.col("day") != LAST_DAY))
    executed = generations.select("row_no", "description", "response")
    joined = executed.join(sent_if_sparse(due), "row_no").select(*due.columns, "description", "response")
    history = pass_history(F.col("description"), F.col("response"))
    return joined.withColumn("messages", chat_part2(history)).drop("description", "response")


def conversation_text(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversations as text: all messages in turn order, ``role: text`` per line.

    A conversation is one prompt, so its messages meet in one row; a message that is there
    twice is in the prompt twice. Messages without a turn come first.
    """
    turn = F.struct("turn", "role", "text")
    grouped = messages.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lines = F.transform("turns", lambda m: told(m["role"], m["text"]))
    return grouped.select(
        key, F.size("turns").alias("turns"), F.array_join(lines, "\n").alias("prompt")
    )
