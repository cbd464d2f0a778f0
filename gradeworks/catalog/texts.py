"""Queries: cleaning of raw documents, and prompts."""

from pyspark.sql import functions as F

from gradeworks import fixed_values as X
from gradeworks.catalog import views as V
from gradeworks.catalog.base import Query
from gradeworks.functions import documents as D
from gradeworks.functions.prompts import render_messages
from gradeworks.functions.text import rstrip_newlines
from gradeworks.operators import corpus as C
from gradeworks.operators import prompts as P
from gradeworks.operators.passes import best_of_k
from gradeworks.operators.tasks import choose_description
from gradeworks.plans.corpus import flat_corpus, refreshed_corpus
from gradeworks.sources.corpus import document_keys

_UNIFIED = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_LINES = "regexp_extract_all({t}, '[^\\n]*\\n|[^\\n]+')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean_sql(source: str, keys: str, header: str, keep_header: bool) -> str:
    """Section cleaning on line lists, over a query with columns ``keys`` and text."""
    head = "CASE WHEN p IS NULL THEN [] ELSE x[p:p] END" if keep_header else "[]"
    return f"""WITH src AS ({source}),
    l AS (SELECT {keys}, {_LINES.format(t=_UNIFIED)} AS x FROM src),
    h AS (SELECT *, list_position(list_transform(x, lambda s: starts_with(s, '{header}')), true)
          AS p FROM l),
    y AS (SELECT {keys}, {head} AS head, CASE WHEN p IS NULL THEN [] ELSE
            list_filter(x[p + 1:], lambda s: NOT contains(s, 'https')) END AS body FROM h),
    q AS (SELECT *, list_position(list_transform(body, lambda s:
            contains(s, 'Your puzzle answer was')), true) AS q FROM y),
    k AS (SELECT {keys}, list_concat(head, CASE WHEN q IS NULL THEN body ELSE body[1:q - 1] END)
          AS z FROM q),
    a AS (SELECT {keys}, CASE WHEN z[1] = chr(10) THEN z[2:] ELSE z END AS z FROM k),
    b AS (SELECT {keys}, CASE WHEN z[len(z)] = chr(10) THEN z[1:len(z) - 1] ELSE z END AS z
          FROM a)
    SELECT {keys}, coalesce(array_to_string(z, ''), '') AS description FROM b"""


_RAW = V.RAW_DOCUMENTS.sql
CLEAN1 = clean_sql(_RAW, "doc_id", X.PART1_HEADER, True)
CLEAN2 = clean_sql(_RAW, "doc_id", X.PART2_HEADER, False)

SPLIT = f"""WITH src AS ({_RAW}), l AS (SELECT doc_id, {_LINES.format(t="text")} AS x FROM src),
    m AS (SELECT *, list_position(list_transform(x, lambda s:
            contains(s, '--- Part Two ---')), true) AS p FROM l),
    s AS (SELECT doc_id, 1 AS part, CASE WHEN p IS NULL THEN x ELSE x[1:p - 1] END AS z FROM m
      UNION ALL SELECT doc_id, 2, list_filter(x[p + 1:], lambda s:
            NOT contains(s, '--- Part Two ---')) FROM m WHERE p IS NOT NULL),
    j AS (SELECT doc_id, part, array_to_string(z, '') AS t FROM s WHERE len(z) > 0),
    parts AS (SELECT doc_id, part, CASE WHEN ends_with(t, chr(10)) THEN t ELSE t || chr(10) END
          AS text FROM j)"""

_ANSWER = """coalesce(array_to_string(list_transform(list_filter(string_split(text, chr(10)),
    lambda s: contains(s, 'Your puzzle answer was ')), lambda s:
    replace(replace(regexp_replace(s, 'Your puzzle answer was ', ''), '`', ''), '.', '')),
    chr(10)), '')"""


def _raw(s, d):
    return V.RAW_DOCUMENTS.frame(s, d)


def _year_day(s, d):
    """Raw documents under the keys of the challenge corpus."""
    keys = V.CHALLENGES.columns
    return s.read.parquet(f"{d}/documents.parquet").selectExpr(
        f"{keys['year']} AS year",
        f"{keys['day']} AS day",
        f"{V.RAW_DOCUMENTS.columns['text']} AS text",
        f"{keys['input']} AS input",
    )


def _messages_text(messages):
    return render_messages(messages).alias("prompt")


def _part2_prompts(s, d):
    attempts = V.TEXT_ATTEMPTS.frame(s, d)
    chosen = best_of_k(attempts, 3).drop("kpass")
    return P.part2_prompts(chosen, attempts).select(
        "row_no", "model", "year", "day", _messages_text(F.col("messages"))
    )


SYSTEM_SQL, PART2_SQL = _quote(X.SYSTEM_MESSAGE), _quote(X.PART2_INSTRUCTION)
_MATH = [_quote(t) for t in X.MATH_INSTRUCTION.replace("{description}", "").split("{title}")]


def math_prompt_sql(title: str, description: str) -> str:
    return f"concat({_MATH[0]}, {title}, {_MATH[1]}, {description})"


_CONVERSION = X.CONVERSION
for _name in ("converted_challenges", "story_part1", "story_part2", "sample_input"):
    _CONVERSION = _CONVERSION.replace("{" + _name + "}", "\0")
_CONVERSION = [_quote(t) for t in _CONVERSION.split("\0")]

QUERIES = [
    Query(
        "parse_doc_keys",
        lambda s, d: V.PART_FILES.frame(s, d).select(
            "doc_id",
            *[
                F.coalesce(c, F.lit(-1)).alias(n)
                for n, c in document_keys(F.col("path")).items()
            ],
        ),
        f"""SELECT doc_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(path, '{{0}}', 1), '')
            AS INTEGER), -1) AS INTEGER) AS year,
            CAST(coalesce(TRY_CAST(nullif(regexp_extract(path, '{{0}}', 2), '') AS INTEGER), -1)
            AS INTEGER) AS day,
            CAST(coalesce(TRY_CAST(nullif(regexp_extract(path, '{{0}}', 3), '') AS INTEGER), -1)
            AS INTEGER) AS part FROM ({V.PART_FILES.sql})""".replace(
            "{0}", "([0-9]+)/day_([0-9]+)_part([0-9]+)[.]md$"
        ),
    ),
    Query(
        "clean_section_keep",
        lambda s, d: _raw(s, d).select(
            "doc_id", D.clean_part1(F.col("text")).alias("description")
        ),
        CLEAN1,
    ),
    Query(
        "clean_section_drop",
        lambda s, d: _raw(s, d).select(
            "doc_id", D.clean_part2(F.col("text")).alias("description")
        ),
        CLEAN2,
    ),
    Query(
        "clean_dispatch",
        lambda s, d: C.clean_parts(_raw(s, d)).select("doc_id", "part", "description"),
        f"""SELECT r.doc_id, r.part, CASE r.part WHEN 1 THEN c1.description
            WHEN 2 THEN c2.description END AS description
        FROM ({_RAW}) r JOIN ({CLEAN1}) c1 ON r.doc_id = c1.doc_id
        JOIN ({CLEAN2}) c2 ON r.doc_id = c2.doc_id""",
    ),
    Query(
        "unknown_parts",
        lambda s, d: C.unknown_parts(_raw(s, d)).select("doc_id", "part"),
        f"SELECT doc_id, part FROM ({_RAW}) WHERE part NOT IN (1, 2)",
    ),
    Query(
        "split_document",
        lambda s, d: C.split_documents(_raw(s, d).drop("part")),
        SPLIT + " SELECT doc_id, part, text FROM parts",
    ),
    Query(
        "extract_answer",
        lambda s, d: _raw(s, d).select("doc_id", D.extract_answer(F.col("text")).alias("answer")),
        f"SELECT doc_id, {_ANSWER} AS answer FROM ({_RAW})",
    ),
    Query(
        "empty_description",
        lambda s, d: C.empty_descriptions(
            C.clean_parts(_raw(s, d).withColumn("part", F.expr("cast(1 + doc_id % 2 AS int)")))
        ).select("doc_id", "part"),
        f"""SELECT c1.doc_id, CAST(1 + c1.doc_id % 2 AS INTEGER) AS part FROM ({CLEAN1}) c1
        JOIN ({CLEAN2}) c2 ON c1.doc_id = c2.doc_id
        WHERE CASE c1.doc_id % 2 WHEN 0 THEN c1.description ELSE c2.description END = ''""",
    ),
    Query(
        "rstrip_newlines",
        lambda s, d: V.CHALLENGES.frame(s, d)
        .where("input IS NOT NULL")
        .select("year", "day", rstrip_newlines(F.col("input")).alias("input")),
        f"""SELECT year, day, rtrim(input, chr(10)) AS input FROM ({V.CHALLENGES.sql})
        WHERE input IS NOT NULL""",
    ),
    Query(
        "refreshed_corpus",
        lambda s, d: refreshed_corpus(V.CHALLENGES.frame(s, d), _year_day(s, d)),
        SPLIT + f""",
        c1 AS ({clean_sql("SELECT * FROM parts WHERE part = 1", "doc_id", X.PART1_HEADER, True)}),
        c2 AS ({clean_sql("SELECT * FROM parts WHERE part = 2", "doc_id", X.PART2_HEADER, False)}),
        d AS (SELECT doc_id, {V.CHALLENGES.columns["year"]} AS year,
            {V.CHALLENGES.columns["day"]} AS day FROM documents),
        n AS (SELECT d.year, d.day, nullif(c1.description, '') AS new1, nullif(c2.description, '') AS new2
            FROM d LEFT JOIN c1 ON d.doc_id = c1.doc_id LEFT JOIN c2 ON d.doc_id = c2.doc_id)
        SELECT k.year, k.day, coalesce(new1, part1) AS part1, part1_converted, part1_solution,
            coalesce(new2, part2) AS part2, part2_converted, part2_solution, input
        FROM ({V.CHALLENGES.sql}) k LEFT JOIN n ON k.year = n.year AND k.day = n.day""",
    ),
    Query(
        "build_corpus",
        lambda s, d: flat_corpus(_year_day(s, d)).select(
            "year", "day", "part1", "part1_solution", "part2", "part2_solution", "input"
        ),
        SPLIT + f""",
        answers AS (SELECT doc_id, part, {_ANSWER} AS answer FROM parts),
        c1 AS ({clean_sql("SELECT * FROM parts WHERE part = 1", "doc_id", X.PART1_HEADER, True)}),
        c2 AS ({clean_sql("SELECT * FROM parts WHERE part = 2", "doc_id", X.PART2_HEADER, False)}),
        d AS (SELECT doc_id, {V.CHALLENGES.columns["year"]} AS year,
            {V.CHALLENGES.columns["day"]} AS day,
            rtrim({V.CHALLENGES.columns["input"]}, chr(10)) AS input FROM documents)
        SELECT d.year, d.day, c1.description AS part1, a1.answer AS part1_solution,
            c2.description AS part2, a2.answer AS part2_solution, d.input
        FROM d LEFT JOIN c1 ON d.doc_id = c1.doc_id LEFT JOIN c2 ON d.doc_id = c2.doc_id
        LEFT JOIN answers a1 ON d.doc_id = a1.doc_id AND a1.part = 1
        LEFT JOIN answers a2 ON d.doc_id = a2.doc_id AND a2.part = 2""",
    ),
    Query(
        "render_prompt",
        lambda s, d: V.PROBLEMS.frame(s, d).select(
            "id", P.math_prompt(F.col("title"), F.col("problem")).alias("prompt")
        ),
        f"""SELECT id, {math_prompt_sql('title', 'problem')} AS prompt
        FROM ({V.PROBLEMS.sql})""",
    ),
    Query(
        "render_prompt_story",
        lambda s, d: V.PROBLEMS.frame(s, d).select(
            "id",
            P.math_prompt(
                F.col("title"), choose_description(F.col("id") % 2 == 0, F.col("story"), F.col("problem"))
            ).alias("prompt"),
        ),
        f"""SELECT id, {math_prompt_sql('title', "CASE WHEN id % 2 = 0 THEN story ELSE problem END")} AS prompt
        FROM ({V.PROBLEMS.sql})""",
    ),
    Query(
        "chat_prompt_described",
        lambda s, d: V.CHALLENGES.frame(s, d).select(
            "year",
            "day",
            _messages_text(P.chat_part2(P.pass_history(F.col("part1"), F.col("input")), F.col("part2"))),
        ),
        f"""SELECT year, day, concat('system: ', {SYSTEM_SQL}, chr(10), 'human: ', part1, chr(10),
            'ai: ', input, chr(10), 'human: ', {PART2_SQL}, chr(10), chr(10), part2) AS prompt
        FROM ({V.CHALLENGES.sql})""",
    ),
    Query(
        "chat_prompt_p1",
        lambda s, d: V.CHALLENGES.frame(s, d).select(
            "year", "day", _messages_text(P.chat_part1(F.col("part1")))
        ),
        f"""SELECT year, day, concat('system: ', {SYSTEM_SQL}, chr(10), 'human: ', part1) AS prompt
        FROM ({V.CHALLENGES.sql})""",
    ),
    Query(
        "chat_prompt_p2",
        _part2_prompts,
        f"""WITH a AS ({V.TEXT_ATTEMPTS.sql}),
        p AS (SELECT *, row_number() OVER (PARTITION BY model, year, day, part, kpass
            ORDER BY row_no) AS copy FROM a WHERE kpass < 3),
        o AS (SELECT *, row_number() OVER (PARTITION BY model, year, day, part ORDER BY CASE
            WHEN status = 'no_error' THEN kpass ELSE 1000 - kpass END) AS rn FROM p
            WHERE copy = 1)
        SELECT row_no, model, year, day, concat('system: ', {SYSTEM_SQL}, chr(10),
            'human: ', description, chr(10), 'ai: ', response, chr(10),
            'human: ', {PART2_SQL}) AS prompt FROM o
        WHERE rn = 1 AND status = 'no_error' AND day <> 25""",
    ),
    Query(
        "conversion_prompt",
        lambda s, d: V.CHALLENGES.frame(s, d).select(
            "year",
            "day",
            P.conversion_prompt(
                F.col("part1_converted"), F.col("part1"), F.col("part2"), F.col("input")
            ).alias("prompt"),
        ),
        f"""SELECT year, day, concat({_CONVERSION[0]}, part1_converted, {_CONVERSION[1]}, part1,
            {_CONVERSION[2]}, part2, {_CONVERSION[3]}, left(input, 50), {_CONVERSION[4]})
            AS prompt FROM ({V.CHALLENGES.sql})""",
    ),
    Query(
        "conversation_prompt",
        lambda s, d: P.conversation_text(V.MESSAGES.frame(s, d)),
        f"""SELECT conv_id, CAST(count(*) AS INTEGER) AS turns,
            string_agg(concat(role, ': ', text), chr(10) ORDER BY
                turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS prompt
        FROM ({V.MESSAGES.sql}) GROUP BY conv_id""",
    ),
    Query(
        "conversation_prompt_long",
        lambda s, d: P.conversation_text(V.JOINED_MESSAGES.frame(s, d)),
        f"""SELECT conv_id, CAST(count(*) AS INTEGER) AS turns,
            string_agg(concat(role, ': ', text), chr(10) ORDER BY
                turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS prompt
        FROM ({V.JOINED_MESSAGES.sql}) GROUP BY conv_id""",
    ),
]
