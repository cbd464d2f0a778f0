"""Text, names and limits that other tools' files and reports depend on.

Nothing here is computed; change a value and stored results stop matching.
"""

# Status of an attempt, in declaration order.
NO_ERROR = "no_error"
SYNTAX_ERROR = "syntax_error"
RUNTIME_ERROR = "runtime_error"
TIMEOUT_ERROR = "timeout_error"
WRONG_OUTPUT = "wrong_output"
NO_OUTPUT = "no_output"
PART1_FAILED = "part1_failed"

STATUSES = [
    NO_ERROR,
    SYNTAX_ERROR,
    RUNTIME_ERROR,
    TIMEOUT_ERROR,
    WRONG_OUTPUT,
    NO_OUTPUT,
    PART1_FAILED,
]

# Words searched in standard error, and the marker of a run over the limit.
SYNTAX_MARK = "SyntaxError:"
TIMEOUT_MARK = "TIMEOUT"
TIME_LIMIT_SECONDS = 60.0
PROVIDER_ERROR_PREFIX = "ProviderError: "

# The calendar of the two-part subset.
FIRST_YEAR = 2015
LAST_YEAR = 2022
FIRST_DAY = 1
LAST_DAY = 25
LAST_CURVE_DAY = 24

# Subset names in result file names, their variant and their printed label.
TWO_PART = "aoc"
MATH = "euler"
VARIANT_NAMES = {TWO_PART: "leet", MATH: "story"}
PLAIN_VARIANT = "original"
REPORT_SUBSETS = ["aoc", "aoc_converted", "euler", "euler_stories"]
SUBSET_LABELS = {
    "aoc": "AoC",
    "aoc_converted": "AoC-Leet",
    "euler": "Euler",
    "euler_stories": "Euler-Stories",
}
ALIAS_WORD = "gpt"
ALIAS_NAME = "gpt3.5"

# Marker words in raw puzzle documents.
PART1_HEADER = "\\---"
PART2_HEADER = "----------"
PART2_MARKER = "--- Part Two ---"
LINK_WORD = "https"
STOP_PHRASE = "Your puzzle answer was"
ANSWER_PHRASE = "Your puzzle answer was "

# Prompt wording.
PART1_INSTRUCTION = (
    "You are a code generator and given a programming task. A file with the input to "
    "your program is called 'input.txt'. Generate only directly executable python code "
    "that prints the result to stdout."
)
SYSTEM_MESSAGE = PART1_INSTRUCTION
PART2_INSTRUCTION = (
    "You are a code generator and given a second part of a programming task. A file with "
    "the input to your program is called 'input.txt'. Generate only directly executable "
    "python code that prints the result to stdout."
)
RESULT_EXTRACTION = (
    "Here is the output of your program: '{program_output}'. Please only return the "
    "resulting number or text and nothing else."
)
MATH_INSTRUCTION = (
    "You are a code generator and given a programming task.\n"
    "Write a function that efficiently solves the given problem. Generate only directly "
    "executable python code that prints the result to stdout.\n"
    "\n"
    "Title: {title}\n"
    "Task: {description}"
)
CONVERSION = (
    "You are given an Advent of Code challenge framed as a Christmas story. Extract the "
    "core problem and rephrase it into a neutral, technical challenge similar to those "
    "found on LeetCode. Pay attention to following aspects:\n"
    "1. The challenge has two parts: Part 1 and Part 2. Label them with 'Part 1:' and "
    "'Part 2:'\n"
    "2. The input to the program is provided through a seperate text file.\n"
    "3. Please include the format of the input file in your challenge.\n"
    "4. Replace names with different names. I give you an already converted challenge as "
    "a guideline for you.\n"
    "\n"
    "Already Converted Challenge:\n"
    "```{converted_challenges}```\n"
    "\n"
    "Input Challenge - Part1:\n"
    "{story_part1}\n"
    "\n"
    "Input Challenge - Part2:\n"
    "{story_part2}\n"
    "\n"
    "First 50 Characters of the input:\n"
    "{sample_input}\n"
    "\n"
)
SAMPLE_INPUT_CHARS = 50

# Categories a Python linter reports.
FINDING_CATEGORIES = ["convention", "refactor", "warning", "error", "fatal"]
