"""Removing repeated result rows by their row order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.status import status_code
from gradeworks.operators.hotkeys import join_sparse_values


def dedup_rows(rows: DataFrame, keys: list[str], keep: str, order: str = "row_no") -> DataFrame:
    """One whole row per key: the first or the last by ``order``, a unique number.

    Only keys and numbers are combined, in a hash aggregate. The keys that have copies then go to the
    rows, which are read a second time, whole: a row that is not kept does not travel.
    """
    pick = F.min(order) if _is_first(keep) else F.max(order)
    groups = rows.groupBy(*keys).agg(pick.alias("kept_row"), F.count("*").alias("group_rows"))
    joined = join_sparse_values(rows, groups, keys, F.col(order), F.col("group_rows") > 1)
    kept = F.col("kept_row").isNull() | (F.col("kept_row") == F.col(order))
    return joined.where(kept).select(*rows.columns)


def dedup_codes(rows: DataFrame, keys: list[str], keep: str, order: str = "row_no") -> DataFrame:
    """Keys and status code of the kept row: all that a report needs, in a hash aggregate."""
    coded = rows.select(*keys, status_code(F.col("status")).alias("code"), order)
    picker = F.min_by if _is_first(keep) else F.max_by
    return coded.groupBy(*keys).agg(picker("code", order).alias("code"))


def _is_first(keep: str) -> bool:
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep}")
    return keep == "first"
