"""Statuses as small integers.

A string in an aggregation buffer forces Spark into sort-based aggregation; an integer
keeps it in the hash aggregate. Operators that pick one status per group therefore carry
the code and turn it back into the name at the end.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeworks.fixed_values import NO_ERROR, STATUSES

OK_CODE = STATUSES.index(NO_ERROR) + 1
# A pass whose model call failed has no status; the run of its task ends there.
FAILED_CALL_CODE = -1


def status_code(status: Column) -> Column:
    """1-based position in the status domain, 0 outside it, null for null."""
    domain = F.array(*[F.lit(s) for s in STATUSES])
    return F.array_position(domain, status).cast("int")


def status_name(code: Column) -> Column:
    """Status for a code; null for 0 and null."""
    domain = F.array(*[F.lit(s) for s in STATUSES])
    return F.get(domain, code - 1)
