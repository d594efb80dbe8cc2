"""Binding of standing evidence to the run it belongs to: by revision, then by scope, never by picking one of many.

Defined results
---------------
* Evidence without a revision is refused.  Of subjects at its revision those with its scope hash count; where a hash is
  missing on one side the strict form refuses and the relaxed form accepts, and says that it wasn't compared.
* More than one subject left is ambiguous, none is unbound; both are refused.  Nulls never match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind(evidence: DataFrame, subjects: DataFrame, *, ident: str, subject: str, revision: str, scope: str, strict: bool = True) -> DataFrame:
    """``(ident, decision, subject, compared)``, one row a piece of evidence.

    Subjects are reduced to one row a revision and scope before they meet the evidence, so nothing multiplies.
    """
    by_scope = subjects.where(F.col(revision).isNotNull()).groupBy(F.col(revision).alias("_r"), F.col(scope).alias("_s")).agg(F.min(subject).alias("_a"), F.max(subject).alias("_b"))
    at = by_scope.groupBy("_r").agg(F.collect_list(F.struct("_s", "_a", "_b")).alias("_at"))
    e = evidence.select(F.col(ident), F.col(revision).alias("_e"), F.col(scope).alias("_h")).join(at, F.col("_e") == F.col("_r"), "left")
    fits = F.filter("_at", lambda x: (x["_s"] == F.col("_h")) if strict else F.coalesce(x["_s"] == F.col("_h"), F.lit(True)))
    e = e.withColumn("_fit", fits)
    least, most = F.array_min(F.transform("_fit", lambda x: x["_a"])), F.array_max(F.transform("_fit", lambda x: x["_b"]))
    none = F.coalesce(F.size("_fit"), F.lit(0)) <= 0
    decision = F.when(F.col("_e").isNull(), "refused_no_revision").when(F.col("_at").isNull(), "refused_unknown_revision").when(none, "refused_other_scope").when(least != most, "refused_ambiguous").otherwise("bound")
    compared = F.exists("_fit", lambda x: x["_s"] == F.col("_h"))
    return e.select(ident, decision.alias("decision"), F.when(decision == "bound", least).alias("subject"), F.when(decision == "bound", F.coalesce(compared, F.lit(False))).alias("compared"))


def affected(callables: DataFrame, hunks: DataFrame, path: list[str]) -> DataFrame:
    """Callables that hunks touch, by the same overlap as spans: see ``spans.hunk_overlap``; each callable once with its hunks' number."""
    from sievework.operators.spans import hunk_overlap

    keys = [c for c in callables.columns if c not in ("start", "end")]
    return hunk_overlap(callables, hunks, path).groupBy(*keys).agg(F.count("*").alias("hunks"), F.count_if(F.col("mode") == "zero_length_anchor").alias("anchors"))


def match_callables(left: DataFrame, right: DataFrame, path: list[str], name: str) -> DataFrame:
    """Callables of two tools matched in stages: by name and start line, else by name alone where both sides have it once.

    ``(*path, name, left_start, right_start, stage)``; what has no partner keeps NULL on the other side.
    """
    a = left.select(*path, F.col(name), F.col("start_line").alias("left_start"))
    b = right.select(*path, F.col(name), F.col("start_line").alias("right_start"))
    keys = [*path, name]
    exact = a.join(b.withColumn("left_start", F.col("right_start")), [*keys, "left_start"]).select(*keys, "left_start", "right_start", F.lit("exact").alias("stage"))
    rest_a = a.join(exact, [*keys, "left_start"], "left_anti").groupBy(*keys).agg(F.collect_list("left_start").alias("ls"))
    rest_b = b.join(exact, [*keys, "right_start"], "left_anti").groupBy(*keys).agg(F.collect_list("right_start").alias("rs"))
    both = rest_a.join(rest_b, keys, "full")
    one = (F.size("ls") == 1) & (F.size("rs") == 1)
    item = lambda x, y, s: F.struct(x.cast("int").alias("left_start"), y.cast("int").alias("right_start"), F.lit(s).alias("stage"))
    none = F.lit(None)
    empty = F.array().cast("array<int>")
    apart = F.concat(F.transform(F.coalesce(F.col("ls").cast("array<int>"), empty), lambda x: item(x, none, "left_only")), F.transform(F.coalesce(F.col("rs").cast("array<int>"), empty), lambda y: item(none, y, "right_only")))
    rows = F.when(one, F.array(item(F.col("ls")[0], F.col("rs")[0], "name"))).otherwise(apart)
    return exact.select(*keys, F.col("left_start").cast("int").alias("left_start"), F.col("right_start").cast("int").alias("right_start"), "stage").unionByName(both.select(*keys, F.inline(rows)))
