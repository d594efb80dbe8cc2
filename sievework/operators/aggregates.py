"""Aggregates that keep missing apart from zero.

Every function groups by the columns it is given and works on empty tables and all-null groups.  A sum, mean or
count over a population without any measured value is NULL unless the function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import status as S
from sievework.functions.numbers import ratio
from sievework.functions.text import line_is_code, lines
from sievework.session import cut

#: Positions of a distribution's summary (fixed values).
POSITIONS = (50, 75, 90, 95, 99)


def line_classes(df: DataFrame, by: list[str], text: str, comment: str) -> DataFrame:
    """Physical lines by class; ``comment`` is the regular expression of what masking takes from a line."""
    line = df.select(*by, F.explode(lines(F.col(text))).alias("line"))
    blank = F.trim("line") == ""
    code = line_is_code(F.col("line"), F.regexp_replace("line", comment, ""))
    counts = line.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(blank).alias("blank"), F.count_if(~blank).alias("nonblank"), F.count_if(code).alias("code"))
    return counts.withColumn("comment", F.col("nonblank") - F.col("code"))


def composition(df: DataFrame, by: list[str]) -> DataFrame:
    """Ratios and identities over total/blank/nonblank/code/comment; identities are NULL where an operand is."""
    return df.select(
        *by, ratio(F.col("code"), F.col("nonblank")).alias("code_ratio"), ratio(F.col("comment"), F.col("nonblank")).alias("comment_ratio"), ratio(F.col("blank"), F.col("total")).alias("blank_ratio"),
        (F.col("code") + F.col("comment") == F.col("nonblank")).alias("nonblank_holds"), (F.col("nonblank") + F.col("blank") == F.col("total")).alias("total_holds"),
    )


def component_rollup(df: DataFrame, subject: list[str], language: str, components: list[str]) -> DataFrame:
    """Sums of components per subject and language and, with a NULL language, per subject, in one pass."""
    sums = [F.sum(c).alias(c) for c in components]
    grouped = df.groupingSets([[*subject, language], subject], *subject, language).agg(F.grouping(language).alias("g"), *sums)
    return grouped.where((F.col("g") == 1) | F.col(language).isNotNull()).drop("g")


def primary_language(df: DataFrame, subject: list[str], language: str, code: str, files: str, order: tuple[str, ...]) -> DataFrame:
    """Most code, then most files, then the fixed order; ``tied`` if the first two share both numbers."""
    place = reduce(lambda c, it: c.when(F.col(language) == it[1], it[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order))
    w = Window.partitionBy(*subject).orderBy(F.col(code).desc_nulls_last(), F.col(files).desc_nulls_last(), place, language)
    ranked = df.withColumn("rn", F.row_number().over(w)).withColumn("tied", F.coalesce((F.lead(code).over(w) == F.col(code)) & (F.lead(files).over(w) == F.col(files)), F.lit(False)))
    return ranked.where("rn = 1").select(*subject, F.col(language).alias("primary_language"), "tied")


def status_rollup(df: DataFrame, by: list[str], statuses: list[str]) -> DataFrame:
    """Combined status of each column and the worst of them."""
    rolled = df.groupBy(*by).agg(*[S.combined(F.col(s)).alias(s) for s in statuses])
    return rolled.withColumn("metric_status", S.worst(*[F.col(s) for s in statuses]))


def running(counts: DataFrame, by: list[str], value: str, n: str, out: str) -> DataFrame:
    """``counts`` with the running sum of ``n`` in order of ``value``, NULL first, and the group's sum as ``<out>_all``.

    Values are range-partitioned, so a group of any size spreads over many tasks: each range sums its own part, and what
    stands before it is added from one row a range.
    """
    placed = cut(counts.repartitionByRange(*by, F.col(value).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy(*by, "_range").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*[f"_g_{b}" for b in by])
    ranges = placed.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by], F.col("_range").alias("_g_range")).agg(F.sum(n).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(whole.orderBy("_g_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*[f"_g_{b}" for b in by], "_g_range", before.alias("_before"), F.sum("_sum").over(whole).alias(f"{out}_all"))
    on = reduce(lambda x, b: x & F.col(b).eqNullSafe(F.col(f"_g_{b}")), by, F.col("_range") == F.col("_g_range"))
    summed = placed.withColumn("_upto", F.sum(n).over(upto)).join(ranges, on)
    return summed.withColumn(out, F.col("_upto") + F.col("_before")).drop("_range", "_upto", "_before", "_g_range", *[f"_g_{b}" for b in by])


def structural_aggregate(df: DataFrame, by: list[str], value: str, gate: Column) -> DataFrame:
    """Counts all rows; total, mean, lower median and maximum over rows the gate admits."""
    counts = df.select(*by, F.when(gate, F.col(value)).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("rows"))
    ranked = running(counts.withColumn("m", F.when(F.col("v").isNotNull(), F.col("rows")).otherwise(0)), by, "v", "m", "upto")
    total = F.sum(F.col("v") * F.col("m"))
    return ranked.groupBy(*by).agg(
        F.sum("rows").alias("n"), F.sum("m").alias("evaluable"), total.alias("total"), F.round(F.try_divide(total, F.sum("m")), 4).alias("mean"),
        F.min(F.when(F.col("upto") * 2 >= F.col("upto_all"), F.col("v"))).alias("median"), F.max("v").alias("max"),
    )


def nothing_measured(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All NULL, the count included, if nothing was measured."""
    n = F.nullif(F.count(value), F.lit(0))
    return df.groupBy(*by).agg(n.alias("measured"), F.sum(value).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("max"))


def frequency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact frequencies, running counts and shares of four decimals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, by, "value", "n", "running").select(*by, "value", "n", "running", F.round(F.col("running") / F.col("running_all"), 4).alias("share"))


def frequency_head(df: DataFrame, by: list[str], value: str, limit: int) -> DataFrame:
    """The most frequent values and how many are hidden."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "value")
    counts = counts.withColumn("place", F.row_number().over(w)).withColumn("hidden", F.greatest(F.count("*").over(Window.partitionBy(*by)) - limit, F.lit(0)))
    return counts.where(F.col("place") <= limit)


def distribution(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Long form, one row a column: measured, unmeasured, extremes, distinct values and nearest-rank percentiles.

    Values are counted first, so only distinct values are sorted; the running count then shows each rank's value.
    """
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")).select(*by, "x.field", "x.v")
    counts = long.groupBy(*by, "field", "v").agg(F.count("*").alias("n")).withColumn("m", F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0))
    ranked = running(counts, [*by, "field"], "v", "m", "upto").withColumnRenamed("upto_all", "total")
    at = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * p / 100), F.lit(1)), F.col("v"))).alias(f"p{p}") for p in POSITIONS]
    return ranked.groupBy(*by, "field").agg(
        F.sum("m").alias("measured"), F.sum(F.col("n") - F.col("m")).alias("unmeasured"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("distinct_values"), *at
    )


def top_rows(df: DataFrame, by: list[str], value: str, ties: list[Column], limit: int) -> DataFrame:
    """The rows with the greatest values, nulls left out, ties broken by the given order."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), *ties)
    return df.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def ordered(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """Each row's place in a group's canonical order, from 1; the order has to be total."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def reconcile(recorded: DataFrame, parts: DataFrame, keys: list[str], dimensions: list[str], status: str) -> DataFrame:
    """Recorded totals against sums of parts, one row a key and dimension.

    A missing part counts as nothing in the sum but is told in ``skipped``.  Outcomes: ``exact``, ``residual``
    and, where the status failed without a value or a side is missing, ``not_evaluable``.
    """
    sums = parts.groupBy(*keys).agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(f"s_{d}") for d in dimensions], *[F.count_if(F.col(d).isNull()).alias(f"m_{d}") for d in dimensions])
    both = recorded.join(sums, keys, "left")
    item = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).cast("bigint").alias("recorded"), F.col(f"s_{d}").cast("bigint").alias("parts"), F.col(f"m_{d}").alias("skipped"))
    long = both.select(*keys, status, F.explode(F.array(*[item(d) for d in dimensions])).alias("x")).select(*keys, status, "x.*")
    residual = F.col("recorded") - F.col("parts")
    missing = F.col("recorded").isNull() | F.col("parts").isNull()
    outcome = F.when(missing, "not_evaluable").when(residual == 0, "exact").otherwise("residual")
    return long.select(*keys, "dimension", "recorded", "parts", "skipped", residual.alias("residual"), outcome.alias("outcome"))


def poisoned_totals(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """A total is NULL as soon as one part is."""
    return df.groupBy(*by).agg(*[F.when(F.count_if(F.col(v).isNull()) == 0, F.sum(v)).alias(v) for v in values])


def label_counts(df: DataFrame, by: list[str], label: str, vocabulary: list[str], other: str = "unclassified") -> DataFrame:
    """Counts over a closed vocabulary, zeros included; NULLs are told under ``other``."""
    seen = df.groupBy(*by, F.coalesce(F.col(label), F.lit(other)).alias("label")).agg(F.count("*").alias("n"))
    every = seen.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(v) for v in [*vocabulary, other]])).alias("label"))
    return every.join(seen, [*by, "label"], "left").select(*by, "label", F.coalesce("n", F.lit(0)).alias("n"))


def sample_profile(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Interpolated median, and percentiles by the rounded index ``round_half_even(f * (n - 1))`` of the sorted samples."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("m"))
    ranked = running(counts, by, "v", "m", "upto").withColumnRenamed("upto_all", "n")
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    last = F.col("n") - 1
    parts = [at(F.bround(F.lit(f) * last)).alias(k) for k, f in fractions.items()]
    return ranked.groupBy(*by).agg(F.sum("m").alias("samples"), ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median"), *parts)


def compare_profiles(before: DataFrame, after: DataFrame, keys: list[str], *, least: int, noise: float) -> DataFrame:
    """Medians of two profiles: ``(*keys, before, after, comparability, delta, within_noise)``.

    The worst verdict wins: a missing side, then too few samples; only comparable sides have a delta.
    """
    a = before.select(*keys, F.col("samples").alias("_na"), F.round("median", 6).alias("before"))
    b = after.select(*keys, F.col("samples").alias("_nb"), F.round("median", 6).alias("after"))
    verdict = F.when(F.col("_na").isNull() | F.col("_nb").isNull(), "side_absent").when(F.least("_na", "_nb") < least, "insufficient_samples").otherwise("comparable")
    delta = F.when(verdict == "comparable", F.round(F.col("after") - F.col("before"), 6))
    return a.join(b, keys, "full").select(*keys, "before", "after", verdict.alias("comparability"), delta.alias("delta"), (F.abs(delta) <= noise).alias("within_noise"))


def reasons(conditions: dict[str, Column]) -> Column:
    """All conditions that hold, by name, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()])), ",")
