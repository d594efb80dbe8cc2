"""Reports as rows of text: Markdown, HTML and JSON, made by expressions and written by any text sink.

Every value is escaped for where it stands; what wasn't measured says so and is never a zero.  Tables are one row of text
a line with its place, so a report of any length is written without being collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.numbers import rendered
from sievework.functions.text import escape_html, escape_markdown, visible_text

_NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint")


def _shown(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return rendered(F.col(c)) if kind in _NUMBERS or kind.startswith("decimal") else F.coalesce(visible_text(F.col(c).cast("string")), F.lit("unavailable"))


def markdown_rows(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``(*keep, line)``: one line of a table a row."""
    cells = [escape_markdown(_shown(df, c)) for c in columns]
    return df.select(*keep, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def html_rows(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), escape_html(_shown(df, c)), F.lit("</td>")) for c in columns]
    return df.select(*keep, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def view_json(df: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """``(*keep, document)``: one object a row, keys in order, NULLs kept."""
    return df.select(*keep, F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("document"))


def fact_sheet(df: DataFrame, keep: list[str], title: str, facts: list[str]) -> DataFrame:
    """``(*keep, text)``: a title and one line a fact."""
    lines = [F.concat(F.lit(f"- {f}: "), escape_markdown(_shown(df, f))) for f in facts]
    return df.select(*keep, F.concat_ws("\n", F.concat(F.lit("# "), escape_markdown(_shown(df, title))), *lines).alias("text"))


def dossier(parts: dict[str, DataFrame], keep: list[str]) -> DataFrame:
    """Sections of one document, ``(*keep, section, line)`` from frames with ``line``; a section without rows isn't told."""
    out = None
    for name, df in parts.items():
        rows = df.select(*keep, F.lit(name).alias("section"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out
