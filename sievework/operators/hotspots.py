"""Hotspots: complexity and churn as rank signals, and the attention they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTENTION = ["high", "moderate", "low"]


def rank_signal(df: DataFrame, value: str, cohort: list[str], out: str) -> DataFrame:
    """Signal of a value by its rank among the distinct values of its cohort; one distinct value is medium.

    Distinct values are ranked, not rows: ranks come from a table of distinct values, so a cohort that holds a
    third of all rows isn't sorted row by row.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*cohort, value).distinct()
    w = Window.partitionBy(*cohort)
    ranked = distinct.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_d", F.count("*").over(w))
    band = F.floor((F.col("_i") * 2) / F.greatest(F.col("_d") - 1, F.lit(1)))
    signal = F.when(F.col("_d") == 1, "medium").when(band == 0, "low").when(band == 1, "medium").otherwise("high")
    keyed = ranked.select(*[F.col(c).alias(f"_s_{c}") for c in cohort], F.col(value).alias("_s_value"), signal.alias(out))
    on = F.col(value) == F.col("_s_value")
    for c in cohort:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return df.join(keyed, on, "left").drop("_s_value", *[f"_s_{c}" for c in cohort])


def attention(complexity: Column, churn: Column) -> Column:
    """high for two high signals, moderate for one or two medium, else low; NULL if a signal is missing."""
    high = (complexity == "high") | (churn == "high")
    return (
        F.when(complexity.isNull() | churn.isNull(), None).when((complexity == "high") & (churn == "high"), "high")
        .when(high | ((complexity == "medium") & (churn == "medium")), "moderate").otherwise("low")
    )


def hotspots(files: DataFrame, complexity: DataFrame, churn: DataFrame, key: list[str], *, complexity_cohort: list[str], churn_cohort: list[str]) -> DataFrame:
    """Files with complexity and churn, their signals and their attention class."""
    rows = files.join(complexity, key, "left").join(churn, key, "left")
    rows = rank_signal(rows, "complexity", complexity_cohort, "complexity_signal")
    rows = rank_signal(rows, "churn", churn_cohort, "churn_signal")
    return rows.withColumn("attention", attention(F.col("complexity_signal"), F.col("churn_signal")))


def lineage_churn(history: DataFrame, renames: DataFrame, scope: list[str]) -> DataFrame:
    """Commits and touched lines of each final path, following exact renames: ``(*scope, path, commits, touched)``.

    ``history``: (*scope, seq, path, added, deleted), greater ``seq`` newer; ``renames``: (*scope, seq, old, new).
    A binary change (no line counts) makes ``touched`` NULL but still counts as a commit.  Without renames this is
    one aggregation; renames are followed by a join a step of the longest chain, on their own small table.
    """
    from sievework.session import cut

    alias = renames.select(*scope, "seq", F.col("old").alias("path"), F.col("new").alias("final"))
    while True:  # newer renames carry older ones on
        nxt = renames.select(*scope, F.col("seq").alias("_s"), F.col("old").alias("final"), F.col("new").alias("_n"))
        later = alias.join(nxt, [*scope, "final"], "left").where(F.col("_s").isNull() | (F.col("_s") > F.col("seq")))
        first = later.groupBy(*scope, "seq", "path", "final").agg(F.min_by("_n", "_s").alias("_n"))
        kept = alias.join(first, [*scope, "seq", "path", "final"], "left").select(*scope, "seq", "path", "final", "_n")
        kept = cut(kept)
        if kept.where("_n is not null").limit(1).count() == 0:
            alias = kept.drop("_n")
            break
        alias = cut(kept.select(*scope, "seq", "path", F.coalesce("_n", "final").alias("final")))
    # A commit belongs to the lineage of the first rename of its path at or after it.
    h = history.join(alias.withColumnRenamed("seq", "_r"), [*scope, "path"], "left").where(F.col("_r").isNull() | (F.col("_r") >= F.col("seq")))
    placed = h.groupBy(*scope, "seq", "path", "added", "deleted").agg(F.min_by("final", "_r").alias("final"))
    unplaced = history.join(placed.select(*scope, "seq", "path"), [*scope, "seq", "path"], "left_anti").withColumn("final", F.col("path"))
    rows = placed.unionByName(unplaced.select(placed.columns)).withColumn("path", F.coalesce("final", "path"))
    touched = F.when(F.count_if(F.col("added").isNull() | F.col("deleted").isNull()) == 0, F.sum(F.col("added") + F.col("deleted")))
    return rows.groupBy(*scope, "path").agg(F.countDistinct("seq").alias("commits"), touched.alias("touched"))
