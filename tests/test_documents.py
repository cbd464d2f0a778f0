"""Document cleaning against a line-by-line restatement in Python."""

import random

from gradeworks.functions.documents import clean_part1, clean_part2, extract_answer
from gradeworks.operators.corpus import (
    build_challenges,
    clean_parts,
    empty_descriptions,
    split_documents,
    unknown_parts,
)

LINES = [
    "\\--- Day 1: Title ---",
    "----------",
    "--- Part Two ---",
    "text",
    "",
    "see https://x.example",
    "Your puzzle answer was `12.5`.",
    "https then Your puzzle answer was `3`.",
    "twice Your puzzle answer was Your puzzle answer was `a`",
    "x \\--- not a header",
    "cr\rinside\u2028line",
    "ends in cr\r",
    "\r",
]


def sample_texts(count=600):
    rng = random.Random(7)
    texts = ["", "\n", "\n\n", "\\---", "\\---\n\n", "----------\n\n\n"]
    for _ in range(count):
        lines = rng.choices(LINES, k=rng.randint(1, 9))
        texts.append("\n".join(lines) + rng.choice(["", "\n", "\n\n"]))
    return texts


def lines_of(text):
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def cleaned(text, header, keep_header):
    lines = lines_of(text.replace("\r\n", "\n").replace("\r", "\n"))
    starts = [i for i, line in enumerate(lines) if line.startswith(header)]
    if not starts:
        return ""
    first = starts[0]
    body = [line for line in lines[first + 1 :] if "https" not in line]
    stops = [i for i, line in enumerate(body) if "Your puzzle answer was" in line]
    body = body[: stops[0]] if stops else body
    body = ([lines[first]] if keep_header else []) + body
    if body and body[0] == "\n":
        body = body[1:]
    if body and body[-1] == "\n":
        body = body[:-1]
    return "".join(body)


def closed(text):
    return text if text == "" or text.endswith("\n") else text + "\n"


def split_at_marker(text):
    lines = lines_of(text)
    marks = [i for i, line in enumerate(lines) if "--- Part Two ---" in line]
    if not marks:
        return closed(text), ""
    later = [line for line in lines[marks[0] :] if "--- Part Two ---" not in line]
    return closed("".join(lines[: marks[0]])), closed("".join(later))


def answers(text):
    phrase = "Your puzzle answer was "
    found = [line.replace(phrase, "", 1) for line in text.split("\n") if phrase in line]
    return "\n".join(found).replace("`", "").replace(".", "").rstrip("\n")


def test_clean_sections(evaluate):
    texts = sample_texts()
    assert evaluate(clean_part1, texts) == [cleaned(t, "\\---", True) for t in texts]
    assert evaluate(clean_part2, texts) == [cleaned(t, "----------", False) for t in texts]


def test_marker_words_are_parameters(evaluate):
    text = "## head\nkeep\nlink://x\nSTOP here\nrest"
    words = {"header": "## ", "link_word": "link://", "stop_phrase": "STOP"}
    assert evaluate(lambda t: clean_part1(t, **words), [text]) == ["## head\nkeep\n"]
    assert evaluate(lambda t: clean_part2(t, **words), [text]) == ["keep\n"]


def test_answers(evaluate):
    texts = sample_texts()
    assert evaluate(extract_answer, texts) == [answers(t) for t in texts]


def test_split(spark):
    texts = sample_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {(r.i, r.part): r.text for r in split_documents(rows).collect()}
    parts = [(i, n, p) for i, t in enumerate(texts) for n, p in enumerate(split_at_marker(t), 1)]
    assert found == {(i, n): p for i, n, p in parts if p}


def test_long_document_is_cleaned_whole(evaluate):
    body = "word " * 40000 + "\n" + "line\n" * 40000
    text = "\\--- A ---\n" + body + "Your puzzle answer was `1`.\n" + body
    assert evaluate(clean_part1, [text]) == ["\\--- A ---\n" + body]


def test_a_filter_on_the_result_does_not_grow_the_plan(frame):
    rows = clean_parts(frame([(1, "a", 0)], "part int, text string, i int"))
    plain = rows._jdf.queryExecution().optimizedPlan().toString()
    filtered = empty_descriptions(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert len(filtered) < 3 * len(plain)


def test_split_documents_rows(frame):
    rows = frame([(1, "a\n--- Part Two ---\nb"), (2, "c"), (3, "--- Part Two ---\nd\n")],
                 "doc int, text string")
    found = {(r.doc, r.part): r.text for r in split_documents(rows).collect()}
    assert found == {(1, 1): "a\n", (1, 2): "b\n", (2, 1): "c\n", (3, 2): "d\n"}


def test_dispatch_by_part(frame):
    text = "\\--- A ---\nx\n----------\ny\n"
    rows = frame([(1, text), (2, text), (3, text), (None, text)], "part int, text string")
    found = {r.part: r.description for r in clean_parts(rows).collect()}
    assert found == {1: text, 2: "y\n", 3: None, None: None}
    assert sorted(str(r.part) for r in unknown_parts(rows).collect()) == ["3", "None"]


def test_empty_descriptions_are_kept_aside(frame):
    rows = frame([(1, "no header"), (2, "----------\n\n")], "part int, text string")
    assert empty_descriptions(clean_parts(rows)).count() == 2


def test_build_challenges(frame):
    text = (
        "\\--- Day 1 ---\nstory\nYour puzzle answer was `7`.\n"
        "--- Part Two ---\n----------\n\nmore\nYour puzzle answer was `0,8`.\n"
    )
    rows = frame([(2015, 1, text, "in\n\n"), (2015, 2, "\\--- B\n", None)],
                 "year int, day int, text string, input string")
    first, second = build_challenges(rows).orderBy("day").collect()
    assert first.part1.description == "\\--- Day 1 ---\nstory\n"
    assert first.part1.answer == "7"
    assert first.part2.description == "more\n"
    assert first.part2.answer == "0,8"
    assert first.input == "in"
    assert second.part2 is None and second.input is None
