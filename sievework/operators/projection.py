"""Projections of a run: the catalogue, what a run means apart from how it was made, diagnostics and explanations.

Defined results
---------------
* A projection keeps absence apart from null: an absent field stays away, a null one is null.
* Diagnostics are capped only where that is asked for, and how many were left out is told.
* Results don't depend on the order of rows; nulls are values of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.scope import scope_hash

#: From best to worst (fixed values).
RANK = ("not_applicable", "complete", "partial", "failed")
#: Languages that an expectation takes together (fixed values).
FAMILIES = {"javascript": ("JavaScript", "TypeScript"), "typescript": ("TypeScript", "JavaScript"), "java": ("Java",), "python": ("Python",), "go": ("Go",)}
#: Python statements that only the language's second version has.
_PYTHON_2 = r"""(?m)^[ \t]*print[ \t]+(?![=(.:,]|in\b|is\b|and\b|or\b|if\b)[^\s#]|^[ \t]*except\s+[^:\n(]+,[^:\n]+:|^[ \t]*raise\s+[A-Za-z_][\w.]*\s*,\s*\S"""


def catalogue(subjects: DataFrame, by: list[str], wide: str, values: list[str], categories: list[str]) -> DataFrame:
    """One wide row a subject: each value of each category as a column, NULL where a category has none."""
    cells = [F.sum(F.when(F.col(wide) == c, F.col(v))).alias(f"{c.lower()}_{v}") for c in categories for v in values]
    return subjects.groupBy(*by).agg(*cells)


def semantic_projection(record: Column, fields: list[str]) -> Column:
    """The allowed fields of a JSON object in order, as JSON; absent ones stay absent, null ones null."""
    held = F.from_json(record, "map<string,string>")
    kept = F.map_filter(held, lambda k, _: k.isin(*fields))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))), {"ignoreNullFields": "false"})


def semantic_hash(rows: DataFrame, by: list[str], identity: list[str], projection: str) -> DataFrame:
    """Hash of what a run says: equal for runs that say the same, however and in which order they were written."""
    return scope_hash(rows.select(*by, *identity, projection).distinct(), by, [*identity, projection]).select(*by, F.col("scope_hash").alias("semantic_hash"), F.col("files").alias("records"))


def capped(df: DataFrame, by: list[str], order: list[Column], text: str, *, rows: int = 25, characters: int = 240) -> DataFrame:
    """The first diagnostics of each group for reading, texts shortened; ``left_out`` tells how many more there are."""
    w = Window.partitionBy(*by)
    out = df.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn("left_out", F.greatest(F.count("*").over(w) - rows, F.lit(0)))
    return out.where(F.col("place") <= rows).withColumn(text, F.substring(text, 1, characters))


def family_status(expected: Column, rows: DataFrame, by: list[str], language: str, files: str, status: str) -> DataFrame:
    """``(*by, expected_status, partial_origin)``: the worst status of the expected family, and who made the subject incomplete."""
    plain = F.lower(F.trim(expected))
    family = F.coalesce(*[F.when(plain == e, F.array(*[F.lit(x) for x in f])) for e, f in FAMILIES.items()])
    rank = F.array_position(F.array(*[F.lit(r) for r in RANK]), F.col(status))
    inside = F.coalesce(F.array_contains("_family", F.col(language)), F.lit(False)) & (F.col(files) > 0)
    held = rows.withColumn("_family", family)
    bad = F.col(status).isin("partial", "failed") & (F.col(files) > 0)
    out = held.groupBy(*by).agg(
        F.max(F.when(inside, rank)).alias("_worst"), F.bool_or(bad & inside).alias("_own"), F.bool_or(bad & ~inside).alias("_other"), F.bool_or(F.col("_family").isNotNull()).alias("_known"),
    )
    state = F.when(~F.col("_known") | F.col("_worst").isNull(), "not_applicable").otherwise(F.element_at(F.array(*[F.lit(r) for r in RANK]), F.col("_worst").cast("int")))
    origin = F.when(F.col("_own") & F.col("_other"), "multiple").when(F.col("_own"), "expected_language_family").when(F.col("_other"), "secondary_supported_language_only").otherwise("none")
    return out.select(*by, state.alias("expected_status"), origin.alias("partial_origin"))


def audit_status(df: DataFrame, by: list[str], included: Column, failed: Column, classes: Column) -> DataFrame:
    """Why a language has no classes, if it has none: ``(*by, status, included, failed, classes)``."""
    n, bad, found = F.count_if(included), F.count_if(included & failed), F.coalesce(F.sum(F.when(included, classes)), F.lit(0))
    state = F.when(n == 0, "not_applicable").when((bad > 0) & (found == 0), "parse_failures").when(found > 0, "classes_detected").when(n >= 5, "suspicious_zero").otherwise("checked_no_classes_found")
    return df.groupBy(*by).agg(state.alias("status"), n.alias("included"), bad.alias("failed"), found.alias("classes"))


def python2(text: Column) -> Column:
    """Whether a text has statements that only Python 2 has; evidence for files that don't parse, never for others."""
    return F.coalesce(text.rlike(_PYTHON_2), F.lit(False))


def diagnostics(parts: dict[str, tuple[DataFrame, Column]], by: list[str]) -> DataFrame:
    """Recorded facts of several tables in one form: ``(*by, category, detail)``."""
    out = None
    for category, (df, detail) in parts.items():
        rows = df.select(*by, F.lit(category).alias("category"), detail.cast("string").alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out


def explain(df: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """One explanation a group: the first rule, in the order given, that holds for any of its rows, and how many rows it explains."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in rules.items()])
    name = F.coalesce(*[F.when(F.col(f"_{n}") > 0, n) for n in rules], F.lit("nothing_to_explain"))
    number = F.coalesce(*[F.when(F.col(f"_{n}") > 0, F.col(f"_{n}")) for n in rules], F.lit(0))
    return counts.select(*by, name.alias("explanation"), number.alias("rows"))


def validation(checks: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Rules across the tables of a run: ``(*by, check, rows)``, how many rows break each; rules that hold give nothing.

    Each check is a frame of the rows that break it, with ``by``.
    """
    out = None
    for name, df in checks.items():
        rows = df.groupBy(*by).agg(F.count("*").alias("rows")).select(*by, F.lit(name).alias("check"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out
