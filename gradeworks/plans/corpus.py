"""From raw puzzle documents to the challenge corpus."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.operators.corpus import build_challenges
from gradeworks.operators.tasks import backfill_descriptions, flatten_parts


def refreshed_corpus(challenges: DataFrame, raw: DataFrame) -> DataFrame:
    """Challenges with the descriptions of freshly cleaned documents, by (year, day).

    A part that cleaned to nothing leaves the old description in place.
    """
    cleaned = build_challenges(raw).select(
        "year",
        "day",
        F.expr("nullif(part1.description, '')").alias("part1"),
        F.expr("nullif(part2.description, '')").alias("part2"),
    )
    return backfill_descriptions(challenges, cleaned)


def flat_corpus(raw: DataFrame) -> DataFrame:
    """The flat challenge table straight from raw documents."""
    return flatten_parts(build_challenges(raw))
