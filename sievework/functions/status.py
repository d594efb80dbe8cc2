"""Status algebra: a status travels beside its value, and unavailable is never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From best to worst (fixed values).
ORDER = ("not_applicable", "complete", "partial", "failed")


def rank(status: Column) -> Column:
    return reduce(lambda c, it: c.when(status == it[1], it[0]), enumerate(ORDER), F.when(F.lit(False), 0))


def name(rank_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ORDER]), rank_ + 1)


def worst(*statuses: Column) -> Column:
    """Worst of several statuses of one row; NULLs don't count."""
    return name(F.greatest(*[rank(s) for s in statuses])) if len(statuses) > 1 else statuses[0]


def combined(status: Column) -> Column:
    """Aggregate: none gives not_applicable, all failed gives failed, any partial or failed gives partial."""
    n, failed, bad = F.count(status), F.count_if(status == "failed"), F.count_if(status.isin("failed", "partial"))
    return F.when(n == 0, "not_applicable").when(failed == n, "failed").when(bad > 0, "partial").otherwise("complete")


def degrade(status: Column, inventory: Column) -> Column:
    """A failed inventory fails everything; a partial one lifts what hasn't failed to partial."""
    return F.when(inventory == "failed", "failed").when((inventory == "partial") & (status != "failed"), "partial").otherwise(status)


def finalize(value: Column, status: Column) -> Column:
    """A value whose status failed is not available."""
    return F.when(status != "failed", value)


def completeness(status: Column) -> Column:
    """Class of a status: complete, partial, unavailable or not_applicable; anything else is unavailable."""
    return F.when(status.isin("complete", "partial", "not_applicable"), status).otherwise("unavailable")
