"""Intervals: union, overlap and nesting.

Spans are inclusive integers inside a path.  A path that holds a large share of all spans is cut into blocks
where that can be done exactly: range joins compare inside blocks, and the union merges blocks before paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_union(df: DataFrame, path: list[str], start: str, end: str, *, block: int = 256) -> DataFrame:
    """Overlapping or adjacent spans merged; null or reversed spans are left out.

    Spans are merged in blocks of lines by their start first; what is left of a path is at most one span every other line,
    however many spans it had, and is merged once more.
    """
    ok = df.where(F.col(start) <= F.col(end)).select(*path, F.col(start).alias("start"), F.col(end).alias("end"), F.lit(1).cast("bigint").alias("spans"))
    inner = _merged(ok.withColumn("_block", F.floor(F.col("start") / block)), [*path, "_block"])
    return _merged(inner.drop("_block"), path)


def _merged(df: DataFrame, by: list[str]) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    flagged = df.withColumn("_far", F.max("end").over(before))
    fresh = F.when(F.col("_far").isNull() | (F.col("start") > F.col("_far") + 1), 1).otherwise(0)
    islands = flagged.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(upto))
    return islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("spans").alias("spans")).drop("_island")


def blocked_range_join(left: DataFrame, right: DataFrame, path: list[str], block: int, condition: Column, l_span: tuple[str, str], r_span: tuple[str, str]) -> DataFrame:
    """Pairs of one path whose spans share a line, by blocks of ``block`` lines; each pair comes out once.

    Both sides stand in every block they touch; a pair is kept in the block of the later start only.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / block), F.floor(F.col(e) / block)))
    a = left.where(F.col(l_span[0]) <= F.col(l_span[1])).withColumn("_block", cells(*l_span))
    b = right.where(F.col(r_span[0]) <= F.col(r_span[1])).withColumn("_block", cells(*r_span))
    first = F.floor(F.greatest(F.col(l_span[0]), F.col(r_span[0])) / block)
    return a.join(b, [*path, "_block"]).where(condition & (F.col("_block") == first)).drop("_block")


def laminar_violations(df: DataFrame, path: list[str], ident: str, start: str, end: str, *, block: int = 64) -> DataFrame:
    """Pairs of spans that overlap without one holding the other: ``(*path, a, b)``, earlier start first."""
    a = df.select(*path, F.col(ident).alias("a"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    b = df.select(*path, F.col(ident).alias("b"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    partial = (F.col("a_start") < F.col("b_start")) & (F.col("b_start") <= F.col("a_end")) & (F.col("a_end") < F.col("b_end"))
    return blocked_range_join(a, b, path, block, partial, ("a_start", "a_end"), ("b_start", "b_end")).select(*path, "a", "b")


def hunk_overlap(spans: DataFrame, hunks: DataFrame, path: list[str], *, block: int = 64) -> DataFrame:
    """Spans (``start``, ``end``) touched by hunks (``at``, ``count``): interval intersection, or an anchor inside for an empty hunk."""
    ends = hunks.withColumn("_hend", F.when(F.col("count") == 0, F.col("at")).otherwise(F.col("at") + F.col("count") - 1))
    hit = (F.col("start") <= F.col("_hend")) & (F.col("at") <= F.col("end"))
    joined = blocked_range_join(spans, ends, path, block, hit, ("start", "end"), ("at", "_hend"))
    return joined.withColumn("mode", F.when(F.col("count") == 0, "zero_length_anchor").otherwise("interval_intersection")).drop("_hend")


def deduplicate_spans(df: DataFrame, path: list[str], start: str, end: str, kind: str, priority: list[str], ident: list[str]) -> DataFrame:
    """Of equal spans the kind of highest priority stays."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind))
    w = Window.partitionBy(*path, start, end).orderBy(F.when(place == 0, len(priority) + 1).otherwise(place), *ident)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
