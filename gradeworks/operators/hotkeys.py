"""Joining rows back to per-group values: sparse values go to the rows, large groups are split."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_ROWS = 1_000_000
SENT_KEYS = 10_000
# A table of narrow rows counts as sparse up to this many of them; up to so many bytes by the
# planner's estimate it is not counted first.
SPARSE_ROWS = 1_000_000
SPARSE_BYTES = 16 << 20


def is_sparse(table: DataFrame) -> bool:
    """The table is small enough to be sent to every task: by its estimated bytes, otherwise counted."""
    estimate = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) <= SPARSE_BYTES:
        return True
    return table.limit(SPARSE_ROWS + 1).count() <= SPARSE_ROWS


def sent_if_sparse(table: DataFrame) -> DataFrame:
    """The table, marked for a broadcast if its size allows that."""
    return F.broadcast(table) if is_sparse(table) else table


def _same(keys: list[str], suffix: str) -> list[Column]:
    """Equality on the keys that also matches null with null, so that no row is lost."""
    return [F.col(k).eqNullSafe(F.col(k + suffix)) for k in keys]


def _renamed(table: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return table.withColumnsRenamed({k: k + suffix for k in keys})


def join_group_values(
    rows: DataFrame, groups: DataFrame, keys: list[str], row_id: Column, size: str = "group_rows"
) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per key) that splits large groups.

    ``groups`` carries the row count of each group in ``size``. Groups of more than
    PIECE_ROWS rows are cut into as many pieces as that takes: their rows are dealt out by a
    hash of ``row_id``, and their one group row is repeated for each piece. The keys of these
    groups are counted first. Without any this is a plain join; up to SENT_KEYS they are
    broadcast, and beyond that joined like any other table.
    """
    values = [c for c in groups.columns if c not in keys and c != size]
    pieces = F.ceil(F.col(size) / PIECE_ROWS).cast("int")
    large = groups.where(F.col(size) > PIECE_ROWS).select(*keys, pieces.alias("pieces"))
    found = large.limit(SENT_KEYS + 1).count()
    others = [c for c in rows.columns if c not in keys]
    if not found:
        matched = _renamed(groups.select(*keys, *values), keys, "_group")
        return rows.join(matched, _same(keys, "_group")).select(*keys, *others, *values)
    cut = _renamed(large, keys, "_cut")
    if found <= SENT_KEYS:
        cut = F.broadcast(cut)
    piece = F.coalesce(F.pmod(F.xxhash64(row_id), F.col("pieces")).cast("int"), F.lit(0))
    dealt = rows.join(cut, _same(keys, "_cut"), "left").select(*rows.columns, piece.alias("piece"))
    every = F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)).alias("piece")
    repeated = _renamed(groups.select(*keys, *values, every), [*keys, "piece"], "_group")
    same_group = [*_same(keys, "_group"), F.col("piece") == F.col("piece_group")]
    return dealt.join(repeated, same_group).select(*keys, *others, *values)


def join_sparse_values(
    rows: DataFrame, groups: DataFrame, keys: list[str], row_id: Column, present: Column, size: str = "group_rows"
) -> DataFrame:
    """Rows with the values of their group, which only groups that are ``present`` need to have.

    While those groups are few they are sent to the tasks, and no row is shuffled, whatever the size
    of a group. Values of other groups are then null. Beyond that all groups are joined, the large ones
    in pieces (``join_group_values``).
    """
    values = [c for c in groups.columns if c not in keys and c != size]
    sparse = groups.where(present).select(*keys, *values)
    if not is_sparse(sparse):
        return join_group_values(rows, groups, keys, row_id, size)
    matched = F.broadcast(_renamed(sparse, keys, "_group"))
    return rows.join(matched, _same(keys, "_group"), "left").select(*rows.columns, *values)
