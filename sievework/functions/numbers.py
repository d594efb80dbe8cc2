"""Strict readings of text cells and null-preserving arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_integer(cell: Column) -> Column:
    """Plain signed decimals only; blanks around, underscores and other digits are refused (NULL)."""
    return F.when(cell.rlike(r"^[+-]?[0-9]+$"), cell.try_cast("bigint"))


def numeric_value(cell: Column) -> Column:
    """A finite number; blanks, booleans, NaN and infinities are no numbers (NULL)."""
    value = F.when(cell.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(cell).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def lenient_boolean(cell: Column) -> Column:
    plain = F.lower(F.trim(cell))
    return F.when(plain.isin("1", "true", "yes", "y", "on"), True).when(plain.isin("0", "false", "no", "n", "off"), False)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Four decimals, NULL on a zero or missing denominator."""
    return F.round(F.try_divide(numerator, denominator), 4)


def version_parts(text: Column) -> Column:
    """``MAJOR.MINOR.PATCH`` as a struct of integers, NULL for any other form."""
    form = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"
    part = lambda i, n: F.regexp_extract(text, form, i).try_cast("int").alias(n)
    return F.when(text.rlike(form), F.struct(part(1, "major"), part(2, "minor"), part(3, "patch")))


def compare(observed: Column, operator: Column, threshold: Column) -> Column:
    """Whether the failing condition holds; NULL where a side is missing or the operator is unknown."""
    return (
        F.when(operator == "gt", observed > threshold).when(operator == "gte", observed >= threshold).when(operator == "lt", observed < threshold)
        .when(operator == "lte", observed <= threshold).when(operator == "eq", observed == threshold).when(operator == "ne", observed != threshold)
    )


def canonical_number(value: Column) -> Column:
    """One spelling for each number: whole ones without a point, others with up to six decimals and no zeros at the end."""
    whole = value.cast("decimal(38,0)").cast("string")
    text = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0+$", ""), "\\.$", "")
    return F.when(value == F.round(value), whole).otherwise(text)


def rendered(value: Column, unavailable: str = "unavailable") -> Column:
    """A value for reading: what wasn't measured says so, and a measured zero stays a zero."""
    return F.coalesce(canonical_number(value.cast("double")), F.lit(unavailable))


def evidence_cell(value: Column) -> Column:
    """A value for a cell of a table: NULL and the empty text stay apart."""
    text = value.cast("string")
    return F.when(text.isNull(), "null").otherwise(F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2))
