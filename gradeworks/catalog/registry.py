"""All registered queries by name."""

from gradeworks.catalog import files, frontier, grading, passes, reports, tasks, texts, trees
from gradeworks.catalog.base import Query


def all_queries() -> dict[str, Query]:
    groups = (passes, reports, grading, tasks, texts, files, frontier, trees)
    found = [q for group in groups for q in group.QUERIES]
    by_name = {q.name: q for q in found}
    if len(by_name) != len(found):
        raise ValueError("two queries share a name")
    return by_name
