"""Two snapshots against each other: file evidence, renames, deltas and their attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import digest


def file_evidence(left: DataFrame, right: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Full join on the key: added, removed, changed, unchanged, and indeterminate where a digest is unknown."""
    a = left.select(*keys, F.col(digest).alias("left_digest"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(digest).alias("right_digest"), F.lit(True).alias("_r"))
    known = F.col("left_digest").isNotNull() & F.col("right_digest").isNotNull()
    state = (
        F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~known, "indeterminate")
        .when(F.col("left_digest") == F.col("right_digest"), "unchanged").otherwise("changed")
    )
    return a.join(b, keys, "full").select(*keys, "left_digest", "right_digest", state.alias("state"))


def numbered_runs(df: DataFrame, group: list[str], run: str, sequence: str) -> DataFrame:
    """Runs of each group in order: ``(*group, run, k, next_run)``, ``k`` from 1.  Rows without a run belong to none."""
    order = Window.partitionBy(*group).orderBy(F.col("_seq").asc_nulls_first(), run)
    runs = df.where(F.col(run).isNotNull()).groupBy(*group, run).agg(F.min(sequence).alias("_seq"))
    return runs.select(*group, run, F.row_number().over(order).alias("k"), F.lead(run).over(order).alias("next_run"))


def with_runs(df: DataFrame, runs: DataFrame, group: list[str], run: str) -> DataFrame:
    named = runs.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col(run).alias("_g_run"), "k", "next_run")
    on = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"_g_{g}")), group, F.col(run) == F.col("_g_run"))
    return df.join(named, on).drop("_g_run", *[f"_g_{g}" for g in group])


def sides(df: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``k`` and ``next_run`` as the earlier and as the later side of each step, both under the later run."""
    left = df.where(F.col("next_run").isNotNull()).withColumn(run, F.col("next_run"))
    return left.drop("k", "next_run"), df.where("k > 1").drop("k", "next_run")


def steps(df: DataFrame, group: list[str], run: str, path: str, fields: list[str]) -> DataFrame:
    """Each file beside itself in the group's previous run: ``(*group, run, path, before, after)``, NULL where it isn't there.

    ``df`` has one row a file and run, with ``k`` and ``next_run``.  One window over the runs of a file, no join of runs.
    """
    order = Window.partitionBy(*group, path).orderBy("k")
    now = df.select(*group, run, path, "k", "next_run", F.struct(*fields).alias("_now"))
    for name, at in (("_was", F.lag("_now")), ("_was_k", F.lag("k")), ("_later_k", F.lead("k"))):
        now = now.withColumn(name, at.over(order))
    item = lambda r, before, after: F.struct(r.alias(run), before.alias("before"), after.alias("after"))
    none = F.when(F.lit(False), F.col("_now"))
    here = F.when(F.col("k") > 1, item(F.col(run), F.when(F.col("_was_k") == F.col("k") - 1, F.col("_was")), F.col("_now")))
    gone = F.when(F.col("next_run").isNotNull() & ~F.coalesce(F.col("_later_k") == F.col("k") + 1, F.lit(False)), item(F.col("next_run"), F.col("_now"), none))
    return now.select(*group, path, F.inline(F.array_compact(F.array(here, gone)))).select(*group, run, path, "before", "after")


def step_evidence(df: DataFrame, digest: str) -> DataFrame:
    """``steps`` with ``left_digest``, ``right_digest`` and the state of ``file_evidence``."""
    left, right = F.col(f"before.{digest}"), F.col(f"after.{digest}")
    state = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(left.isNull() | right.isNull(), "indeterminate")
        .when(left == right, "unchanged").otherwise("changed")
    )
    return df.withColumns({"left_digest": left, "right_digest": right, "state": state})


def exact_renames(evidence: DataFrame, scope: list[str], path: str) -> DataFrame:
    """Removed and added files of equal content: one to one is a rename, else one ambiguous row a digest.

    Both sides are reduced to one row a digest before they meet, so copies of a file never multiply.
    """
    gone = evidence.where((F.col("state") == "removed") & F.col("left_digest").isNotNull()).groupBy(*scope, F.col("left_digest").alias("digest"))
    came = evidence.where((F.col("state") == "added") & F.col("right_digest").isNotNull()).groupBy(*scope, F.col("right_digest").alias("digest"))
    a = gone.agg(F.count("*").alias("n_old"), F.min(path).alias("old_path"))
    b = came.agg(F.count("*").alias("n_new"), F.min(path).alias("new_path"))
    one = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    both = a.join(b, [*scope, "digest"])
    return both.select(*scope, "digest", F.when(one, "exact").otherwise("ambiguous").alias("kind"), F.when(one, F.col("old_path")).alias("old_path"), F.when(one, F.col("new_path")).alias("new_path"), "n_old", "n_new")


def deltas(left: DataFrame, right: DataFrame, keys: list[str], dimensions: list[str], *, drop_zero: bool = True) -> DataFrame:
    """Long-form deltas; a side that is missing gives a NULL delta with its reason, never zero."""
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(d).cast("double").alias(f"l_{d}") for d in dimensions])
    b = right.select(*keys, F.lit(True).alias("_r"), *[F.col(d).cast("double").alias(f"r_{d}") for d in dimensions])
    both = a.join(b, keys, "full")
    item = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(f"l_{d}").alias("before"), F.col(f"r_{d}").alias("after"))
    long = both.select(*keys, "_l", "_r", F.explode(F.array(*[item(d) for d in dimensions])).alias("x")).select(*keys, "_l", "_r", "x.*")
    reason = F.when(F.col("_l").isNull() | F.col("_r").isNull(), "side_absent").when(F.col("before").isNull() | F.col("after").isNull(), "measurement_unavailable")
    out = long.select(*keys, "dimension", "before", "after", (F.col("after") - F.col("before")).alias("delta"), reason.alias("reason"))
    return out.where(F.col("delta").isNull() | (F.col("delta") != 0)) if drop_zero else out


def attribute(evidence: DataFrame, keys: list[str], scope: list[str], left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """The scope's change of a value from its files: added - removed + changed, against the totals' difference."""
    a = left.select(*keys, F.col(value).alias("l_value"))
    b = right.select(*keys, F.col(value).alias("r_value"))
    return attribute_rows(evidence.join(a, keys, "left").join(b, keys, "left"), scope)


def attribute_rows(rows: DataFrame, scope: list[str]) -> DataFrame:
    """``attribute`` over rows that already hold ``state``, ``l_value`` and ``r_value``."""
    part = lambda state, v: F.sum(F.when(F.col("state") == state, v))
    missing = F.count_if(F.when(F.col("state").isin("added", "changed", "unchanged"), F.col("r_value").isNull()).otherwise(F.lit(False)) | F.when(F.col("state").isin("removed", "changed", "unchanged"), F.col("l_value").isNull()).otherwise(F.lit(False)))
    zero = F.lit(0)
    summed = rows.groupBy(*scope).agg(
        F.coalesce(part("added", F.col("r_value")), zero).alias("added"), F.coalesce(part("removed", F.col("l_value")), zero).alias("removed"),
        F.coalesce(part("changed", F.col("r_value") - F.col("l_value")), zero).alias("changed"),
        F.sum(F.coalesce("r_value", zero) - F.coalesce("l_value", zero)).alias("delta"), missing.alias("missing"),
    )
    residual = F.col("delta") - (F.col("added") - F.col("removed") + F.col("changed"))
    bad = F.col("missing") > 0
    outcome = F.when(bad, "not_evaluable").when(residual == 0, "exact_reconciliation").otherwise("unexplained_residual")
    return summed.select(*scope, "added", "removed", "changed", F.when(~bad, F.col("delta")).alias("delta"), F.when(~bad, residual).alias("residual"), outcome.alias("outcome"))


def transitions(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields whose value differs between the sides, NULL being a value."""
    a = left.select(*keys, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields])
    b = right.select(*keys, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields])
    return transitions_of(a.join(b, keys), keys, fields)


def transitions_of(both: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``transitions`` over rows that hold both sides as ``l_`` and ``r_`` columns."""
    item = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("before"), F.col(f"r_{f}").alias("after"))
    long = both.select(*keys, F.explode(F.array(*[item(f) for f in fields])).alias("x")).select(*keys, "x.*")
    return long.where(~F.col("before").eqNullSafe(F.col("after")))


def comparability(left: DataFrame, right: DataFrame, keys: list[str], blocking: list[str], reported: list[str]) -> DataFrame:
    """Verdict per key: refused on a blocking difference, qualified on a reported one, else comparable."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in [*blocking, *reported]])
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in [*blocking, *reported]])
    differs = lambda cs: F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in cs]))
    both = a.join(b, keys).select(*keys, differs(blocking).alias("blocking"), differs(reported).alias("reported"))
    verdict: Column = F.when(F.size("blocking") > 0, "incomparable").when(F.size("reported") > 0, "qualified").otherwise("comparable")
    return both.select(*keys, verdict.alias("verdict"), F.array_join(F.concat("blocking", "reported"), ",").alias("differences"))


def identity_changes(left: DataFrame, right: DataFrame, keys: list[str], identity: str, declared: list[str]) -> DataFrame:
    """Whether a subject's source is the same on both sides, and which declared dimensions differ: ``(*keys, before, after, source, differences)``."""
    a = left.select(*keys, F.col(identity).alias("before"), *[F.col(c).alias(f"l_{c}") for c in declared])
    b = right.select(*keys, F.col(identity).alias("after"), *[F.col(c).alias(f"r_{c}") for c in declared])
    source = F.when(F.col("before").isNull() | F.col("after").isNull(), "unknown").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in declared]))
    return a.join(b, keys).select(*keys, "before", "after", source.alias("source"), F.array_join(differs, ",").alias("differences"))


def change_ids(changes: DataFrame, scope: list[str], old_path: str, new_path: str, kind: str) -> DataFrame:
    """Changes with ``change_id`` and their place in canonical order: by the earlier path, files that had none last, then the later path and kind."""
    ident = digest(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*scope, old_path, new_path, kind]], prefix="change:")
    order = Window.partitionBy(*scope).orderBy(F.col(old_path).asc_nulls_last(), F.col(new_path).asc_nulls_last(), kind)
    return changes.withColumns({"change_id": ident, "place": F.row_number().over(order).cast("bigint")})


def row_deltas(steps_: DataFrame, keys: list[str], values: list[str], state: str) -> DataFrame:
    """Per-file deltas of ``steps``: ``(*keys, state, dimension, before, after, delta, reason)``, equal values left out."""
    item = lambda v: F.struct(F.lit(v).alias("dimension"), F.col(f"before.{v}").cast("double").alias("before"), F.col(f"after.{v}").cast("double").alias("after"))
    long = steps_.select(*keys, F.col(state).alias("state"), F.explode(F.array(*[item(v) for v in values])).alias("x")).select(*keys, "state", "x.*")
    reason = F.when(F.col("state").isin("added", "removed"), "side_absent").when(F.col("before").isNull() | F.col("after").isNull(), "measurement_unavailable")
    return long.withColumns({"delta": F.col("after") - F.col("before"), "reason": reason}).where(~F.col("before").eqNullSafe(F.col("after")))
