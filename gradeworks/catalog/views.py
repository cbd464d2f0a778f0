"""Engine inputs derived from the given tables.

Keys grow with the tables: models follow the users, years follow the documents.
"""

from gradeworks.catalog.base import View

_STATUS = (
    "CASE event_type WHEN 'signup' THEN 'no_error' WHEN 'click' THEN 'wrong_output' "
    "WHEN 'view' THEN 'runtime_error' WHEN 'error' THEN 'syntax_error' "
    "ELSE 'timeout_error' END"
)
_MODEL = "concat('m', cast(cast(floor(user_id / 30) AS bigint) AS string))"

# About five attempts per task, with gaps and repeated pass numbers.
ATTEMPTS = View(
    "events",
    {
        "row_no": "event_id",
        "model": _MODEL,
        "year": "cast(2015 + event_id % 8 AS int)",
        "day": "cast(1 + floor(event_id / 8) % 25 AS int)",
        "part": "cast(1 + floor(event_id / 200) % 2 AS int)",
        "kpass": "cast(floor(event_id / 400) % 5 AS int)",
        "status": _STATUS,
    },
)

# The same with up to fifty passes, one of them numbered below 0, and rows without a status;
# a failed call is text of the two-part subset and no end of its passes.
OPEN_ATTEMPTS = View(
    "events",
    ATTEMPTS.columns
    | {
        "day": "cast(1 + floor(event_id / 8) % 5 * 6 AS int)",
        "part": "cast(1 + floor(event_id / 40) % 2 AS int)",
        "kpass": "cast(floor(event_id / 80) % 51 - 1 AS int)",
        "status": f"CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 > 1 THEN 'wrong_output' ELSE {_STATUS} END",
        "provider_error": "CASE WHEN event_id % 11 = 0 THEN 'no answer' END",
    },
)

# Result rows of one flat list per model: math problems with repeated ids.
RESULTS_MATH = View(
    "events",
    {
        "row_no": "event_id",
        "model": _MODEL,
        "id": "cast(event_id % 500 AS int)",
        "status": _STATUS,
        "difficulty": "cast(5 * (event_id % 20) AS string)",
    },
)

# (year, day) pairs as users produce them, with gaps at small sizes.
USER_DAYS = View(
    "events",
    {
        "row_no": "event_id",
        "year": "cast(2015 + user_id % 8 AS int)",
        "day": "cast(1 + user_id % 25 AS int)",
        "part": "cast(1 + floor(event_id / 4) % 2 AS int)",
        "status": _STATUS,
    },
)

# Tasks that users ask for; some have no challenge.
ASKED_DAYS = View(
    "events",
    {
        "row_no": "event_id",
        "year": "cast(2015 + user_id % 8 AS int)",
        "day": "cast(1 + user_id % 28 AS int)",
    },
)

_FOLDER = (
    "concat(CASE WHEN floor(user_id / 30) % 3 = 1 THEN 'gpt-4-' ELSE 'mix-7b-' END, "
    "cast(cast(floor(user_id / 30) AS bigint) AS string))"
)
_STEM_MODEL = (
    "concat(CASE WHEN user_id % 30 = 29 THEN 'old-' ELSE '' END, "
    "CASE WHEN floor(user_id / 30) % 3 = 1 THEN 'gpt3.5' ELSE concat('mix_7b_', "
    "cast(cast(floor(user_id / 30) AS bigint) AS string)) END)"
)
_SUBSET = (
    "CASE event_id % 4 WHEN 0 THEN 'aoc' WHEN 1 THEN 'aoc_converted' "
    "WHEN 2 THEN 'euler' ELSE 'euler_stories' END"
)
_K = "CASE WHEN floor(event_id / 4) % 2 = 0 THEN '1' ELSE '3' END"

# Rows of many results files, two-part and math, with the path of their file. One user in
# thirty has a name with a field too many.
RESULT_FILES = View(
    "events",
    {
        "row_no": "event_id",
        "path": f"concat('/runs/', {_FOLDER}, '/', {_STEM_MODEL}, '-', {_SUBSET}, "
        f"'-pass@', {_K}, '.csv')",
        "year": "CASE WHEN event_id % 4 < 2 THEN "
        "cast(2015 + floor(event_id / 8) % 4 AS int) END",
        "day": "CASE WHEN event_id % 4 < 2 THEN cast(1 + floor(event_id / 32) % 25 AS int) END",
        "part": "CASE WHEN event_id % 4 < 2 THEN cast(1 + user_id % 2 AS int) END",
        "id": "CASE WHEN event_id % 4 >= 2 THEN cast(floor(event_id / 8) % 150 AS int) END",
        "status": _STATUS,
    },
)

FOLDERS = View("events", {"folder": _FOLDER})

# Program runs with their expected answer.
RUNS = View(
    "events",
    {
        "row_no": "event_id",
        "stdout": "concat('  ', cast(user_id AS string), "
        "CASE WHEN event_id % 2 = 0 THEN '' ELSE ' items' END, chr(10))",
        "stderr": "CASE event_type WHEN 'error' THEN 'File x SyntaxError: bad' "
        "WHEN 'view' THEN 'ValueError: TIME' "
        "WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'TIMEOUT' ELSE '' END ELSE '' END",
        "solution": "cast(CASE WHEN event_id % 5 = 0 THEN user_id ELSE user_id + 1 END "
        "AS string)",
        "duration_s": "value",
    },
)

# The same with the exit code of the run, where there is one.
EXITED_RUNS = View("events", {**RUNS.columns, "exit_code": "CASE WHEN event_id % 3 < 2 THEN cast(event_id % 3 AS int) END"})

# Program runs under the keys of the attempts.
TASK_RUNS = View(
    "events",
    {
        **{n: ATTEMPTS.columns[n] for n in ("model", "year", "day", "part", "kpass")},
        **RUNS.columns,
        "code": "concat('print(', cast(event_id AS string), ')')",
    },
)

# The same runs with the re-extracted answer in the row, as a stream delivers them.
RUNS_WITH_TEXT = View(
    "events",
    {
        **RUNS.columns,
        "second_text": "CASE WHEN value >= 10 THEN cast(user_id + 1 AS string) END",
    },
)

REEXTRACTIONS = View(
    "events", {"row_no": "event_id", "text": "cast(user_id + 1 AS string)"}, "value >= 10"
)

# The same runs and answers with the time they come; an answer has a time of its own.
TIMED_RUNS = View("events", {**RUNS.columns, "ended_at": "cast(ts AS timestamp)"})
TIMED_ANSWERS = View(
    "events", {"row_no": "event_id", "text": "cast(user_id + 1 AS string)", "asked_at": "cast(ts AS timestamp)"}, "value >= 10"
)

# Model calls; the ones a provider refused carry an error.
CALLS = View(
    "events",
    {
        "row_no": "event_id",
        "model": _MODEL,
        "id": "cast(event_id % 500 AS int)",
        "kpass": "cast(floor(event_id / 500) % 4 AS int)",
        "response": "concat('print(', cast(user_id AS string), ')')",
        "provider_error": "CASE WHEN value > 120 THEN concat('limit ', props) END",
        "status": _STATUS,
    },
)

# Runs of math problems; some model calls failed before there was anything to run.
PROBLEM_RUNS = View(
    "events",
    {
        **{n: CALLS.columns[n] for n in ("model", "id", "kpass", "provider_error")},
        **RUNS.columns,
        "code": "concat('print(', cast(event_id AS string), ')')",
    },
)

# Responses with python fences, plain fences, no fence and an open fence.
GENERATIONS = View(
    "documents",
    {
        "row_no": "doc_id",
        "model": "source",
        "response": "CASE doc_id % 4 "
        "WHEN 0 THEN concat('x ```python', chr(10), text, '``` y ```', lang, '``` ```python', "
        "source, '```') "
        "WHEN 1 THEN concat('see ```', text, '``` and ```', lang, '```') "
        "WHEN 2 THEN text ELSE concat('open ```python', text) END",
    },
)

# Responses whose validity is known from their form: a string literal, a broken
# definition, and a fenced literal.
_LITERAL = "concat('answer = r', repeat(chr(39), 3), replace(text, chr(39), ''), ' ', "\
    "repeat(chr(39), 3), chr(10))"
SNIPPETS = View(
    "documents",
    {
        "row_no": "doc_id",
        "model": "source",
        "form": "cast(doc_id % 3 AS int)",
        "valid": "doc_id % 3 = 0",
        "literal": _LITERAL,
        "response": f"CASE doc_id % 3 WHEN 0 THEN {_LITERAL} "
        "WHEN 1 THEN concat('def f(:', chr(10), text) "
        f"ELSE concat('Sure!', chr(10), '```python', {_LITERAL}, '```') END",
    },
)

# Free-text answers.
ANSWERS = View(
    "documents",
    {
        "row_no": "doc_id",
        "answer": "concat(' ', text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE "
        "concat(' 12 and ', cast(doc_id * 7 AS string), '.') END)",
        "solution": "CASE doc_id % 4 WHEN 0 THEN '0' WHEN 1 THEN lang "
        "ELSE cast(doc_id * 7 AS string) END",
    },
)
ANSWER_TEXTS = View("documents", {"row_no": "doc_id", "text": "concat(lang, ' ')"}, "lang <> 'es'")

_LEFT = "substring(text, 1, cast(floor(length(text) / 2) AS int))"
_RIGHT = "substring(text, cast(floor(length(text) / 2) AS int) + 1)"

# One challenge per document, its text shared out between the parts.
CHALLENGES = View(
    "documents",
    {
        "year": "cast(2015 + floor(doc_id / 25) AS int)",
        "day": "cast(1 + doc_id % 25 AS int)",
        "part1": _LEFT,
        "part1_converted": f"CASE WHEN lang <> 'de' THEN concat('converted: ', {_LEFT}) END",
        "part1_solution": "cast(n_chars AS string)",
        "part2": _RIGHT,
        "part2_converted": f"CASE WHEN lang = 'en' THEN concat('converted: ', {_RIGHT}) END",
        "part2_solution": "CASE WHEN doc_id % 25 = 24 THEN '' "
        "ELSE concat('0', cast(n_chars AS string)) END",
        "input": "CASE WHEN lang <> 'fr' THEN concat(text, chr(10), chr(10)) END",
    },
)

# The same challenges, one row per part and one row per input.
PART_RECORDS = [
    View(
        "documents",
        {
            "year": CHALLENGES.columns["year"],
            "day": CHALLENGES.columns["day"],
            "part": f"{n}",
            "row_no": "doc_id",
            "description": CHALLENGES.columns[f"part{n}"],
            "answer": CHALLENGES.columns[f"part{n}_solution"],
        },
        None if n == 1 else "lang <> 'es'",
    )
    for n in (1, 2)
]
INPUTS = View(
    "documents",
    {
        "year": CHALLENGES.columns["year"],
        "day": CHALLENGES.columns["day"],
        "input": "concat(source, chr(10), text)",
    },
)

# Fresh descriptions for the challenges in two of the languages.
FRESH = View(
    "documents",
    {
        "year": CHALLENGES.columns["year"],
        "day": CHALLENGES.columns["day"],
        "part1": "concat('fresh ', text)",
        "part2": "CASE WHEN lang = 'en' THEN concat('fresh ', lang, ' ', text) END",
    },
    "lang IN ('en', 'de')",
)

PROBLEMS = View(
    "documents",
    {
        "id": "cast(doc_id % 2000000000 AS int)",
        "title": "source",
        "problem": _LEFT,
        "difficulty": "cast(5 * (doc_id % 20) AS string)",
        "solution": "cast(n_chars AS string)",
        "story": _RIGHT,
    },
)

# Raw puzzle documents around the given texts; some lack the header, the answer or the
# second part.
RAW_TEXT = (
    "concat('preamble ', lang, chr(10), "
    "CASE WHEN doc_id % 5 = 1 THEN '' "
    "ELSE concat(chr(92), '--- Day: ', source, ' ---', chr(10)) END, "
    f"chr(10), {_LEFT}, chr(10), 'share https://x.example/', lang, chr(10), "
    "CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) END, "
    "CASE WHEN doc_id % 5 = 2 THEN '' ELSE "
    "concat('Your puzzle answer was `', cast(doc_id AS string), '.5`.', chr(10)) END, "
    "CASE WHEN doc_id % 5 = 3 THEN '' ELSE concat('--- Part Two ---', chr(10)) END, "
    "CASE WHEN doc_id % 5 = 4 THEN '' ELSE concat('----------', chr(10)) END, "
    f"chr(10), {_RIGHT}, chr(10), chr(10), "
    "'Your puzzle answer was `', cast(n_chars AS string), '`.', chr(10), 'tail ', "
    "CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE lang END)"
)
RAW_DOCUMENTS = View(
    "documents",
    {
        "doc_id": "doc_id",
        "part": "cast(1 + doc_id % 3 AS int)",
        "text": f"CASE WHEN doc_id % 4 = 1 THEN replace({RAW_TEXT}, chr(10), concat(chr(13), chr(10))) "
        f"WHEN doc_id % 4 = 2 THEN replace({RAW_TEXT}, ' ', chr(13)) ELSE {RAW_TEXT} END",
    },
)

PART_FILES = View(
    "documents",
    {
        "doc_id": "doc_id",
        "path": "concat('/puzzles/', cast(2015 + doc_id % 8 AS string), '/day_', "
        "cast(1 + doc_id % 25 AS string), CASE doc_id % 3 WHEN 0 THEN '_part1.md' "
        "WHEN 1 THEN '_part2.md' ELSE '.md' END)",
    },
)

# Attempts with their texts, for prompts and exports.
TEXT_ATTEMPTS = View(
    "documents",
    {
        "row_no": "doc_id",
        "model": "source",
        "year": "cast(2015 + floor(doc_id / 60) AS int)",
        "day": "cast(1 + doc_id % 25 AS int)",
        "part": "1",
        "kpass": "cast(floor(doc_id / 20) % 3 AS int)",
        "status": "CASE lang WHEN 'en' THEN 'wrong_output' ELSE 'no_error' END",
        "description": "concat('Task ', cast(doc_id AS string))",
        "response": "CASE WHEN doc_id % 9 > 0 THEN text END",
    },
)

RESULT_CSV = View(
    "documents",
    {
        "row_no": "doc_id",
        "year": "cast(2015 + floor(doc_id / 50) AS int)",
        "day": "cast(1 + doc_id % 25 AS int)",
        "part": "cast(1 + floor(doc_id / 25) % 2 AS int)",
        "status": "CASE lang WHEN 'en' THEN 'wrong_output' ELSE 'no_error' END",
        "output": "concat(' ', lang, ', ', chr(34), source, chr(34), chr(10))",
        "expected_output": "concat('0', cast(n_chars AS string))",
        "error": "CASE lang WHEN 'en' THEN concat('Error: ', chr(10), source) END",
        "code": "concat('  ', text, chr(10))",
        "kpass": "CASE WHEN doc_id % 3 > 0 THEN cast(doc_id % 3 AS double) END",
    },
)

SNIPPET_LINES = View(
    "documents",
    {
        "model": "concat('m', cast(doc_id % 16 AS string))",
        "snippet_id": "doc_id",
        "text": "text",
    },
)
FINDINGS = View(
    "labels",
    {
        "model": "concat('m', cast(doc_id % 16 AS string))",
        "snippet_id": "doc_id",
        "category": "CASE WHEN toxic = 1 AND quality = 0 THEN 'error' "
        "WHEN toxic = 1 THEN 'warning' WHEN quality = 0 THEN 'refactor' "
        "ELSE 'convention' END",
    },
)

# Some messages lack their text, some their role.
MESSAGES = View(
    "conversations",
    {
        "conv_id": "conv_id",
        "turn": "turn",
        "role": "CASE WHEN (conv_id + turn) % 11 > 0 THEN role END",
        "text": "CASE WHEN (conv_id + turn) % 7 > 0 THEN text END",
    },
)

# Conversations run into one another, some past a hundred turns, with repeated turns.
JOINED_MESSAGES = View(
    "conversations",
    MESSAGES.columns | {"conv_id": "cast(floor(conv_id / 40) AS bigint)"},
)
