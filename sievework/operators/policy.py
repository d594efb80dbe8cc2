"""Threshold policies and baselines, with explicit outcomes where nothing can be said.

Rules are authored by hand and few; a rule table is broadcast.  Observations are judged in one pass for all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.numbers import canonical_number, compare
from sievework.functions.text import digest

STATUSES = ["violated", "passed", "not_evaluable", "not_applicable", "evaluation_error"]


def judge(observations: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``(rule_id, *keys, metric, observed, status, reason)``, first matching outcome.

    ``observations``: (*keys, metric, value, completeness); ``rules``: (rule_id, metric, operator, threshold, partial_data).
    A missing observation comes as NULL completeness; partial values are refused by rules that say so.
    """
    return _judged(observations.join(authored(rules), "metric"), keys)


def _judged(joined: DataFrame, keys: list[str]) -> DataFrame:
    state, value = F.col("completeness"), F.col("value")
    refused = (state == "partial") & (F.col("partial_data") == "not_evaluable")
    reason = (
        F.when(state.isNull(), "measurement_absent").when(state == "unavailable", "measurement_unavailable")
        .when(refused, "partial_data_refused").when((state != "not_applicable") & value.isNull(), "measurement_unavailable")
    )
    fires = compare(value, F.col("operator"), F.col("threshold"))
    status = (
        F.when(state == "evaluation_error", "evaluation_error").when(state == "not_applicable", "not_applicable").when(reason.isNotNull(), "not_evaluable")
        .when(fires, "violated").otherwise("passed")
    )
    return joined.select("rule_id", *keys, "metric", value.alias("observed"), status.alias("status"), F.when(status == "not_evaluable", reason).alias("reason"))


def waive(findings: DataFrame, waivers: DataFrame, subject: str, today) -> DataFrame:
    """Waivers touch violations only, match rule and subject (NULL: every subject) and must not have expired.

    ``waivers`` has ``place``, the order they were written in; the first live one that matches is named.
    """
    first = F.min_by("waiver_id", "place")
    live = waivers.where(F.col("expires_on").isNull() | (F.col("expires_on") >= today))
    every = live.where(F.col("subject").isNull()).groupBy("rule_id").agg(F.struct(F.min("place").alias("place"), first.alias("id")).alias("w_all"))
    own = live.where(F.col("subject").isNotNull()).groupBy("rule_id", F.col("subject").alias(subject)).agg(F.struct(F.min("place").alias("place"), first.alias("id")).alias("w_own"))
    both = findings.join(authored(every), "rule_id", "left").join(authored(own), ["rule_id", subject], "left")
    waiver = F.when(F.col("status") == "violated", F.least("w_all", "w_own")["id"])
    return both.withColumn("waiver_id", waiver).drop("w_all", "w_own")


#: Rules and waivers are written by hand; so many at most are broadcast, and more are refused.
AUTHORED = 10_000


def authored(df: DataFrame) -> DataFrame:
    """A table written by hand, broadcast after its size was checked."""
    if df.limit(AUTHORED + 1).count() > AUTHORED:
        raise ValueError(f"more than {AUTHORED} rules or waivers")
    return F.broadcast(df)


#: From most to least severe (fixed values).
SEVERITIES = ("violation", "warning", "info")


def requires_failure(severity: Column, status: Column, fail_on_not_evaluable: bool) -> Column:
    """Only violations fail a run: what is violated and, if asked for, what can't be judged."""
    bad = status == "violated"
    return (severity == "violation") & (bad | (status == "not_evaluable") if fail_on_not_evaluable else bad)


def finding_id(*parts: Column) -> Column:
    """Identity of a finding: its rule and coordinates, framed and hashed; a missing coordinate is empty."""
    return digest(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts], prefix="finding:")


def finding_order(severity: str, *coordinates: str) -> list[Column]:
    """Total order of findings: severity first, then coordinates, missing ones first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col(severity))
    return [rank, *[F.col(c).asc_nulls_first() for c in coordinates]]


def unit_findings(rows: DataFrame, rules: DataFrame, keys: list[str], metrics: list[str], *, language: str, path: str) -> DataFrame:
    """Rules over rows of a ledger in one pass, whatever their number: ``(rule_id, *keys, metric, observed, status, reason)``.

    ``rules`` adds to ``judge``'s columns ``languages`` (lower case, empty for all), ``admit`` and ``refuse`` (regular
    expressions of paths, NULL for none).  A row that a rule doesn't select gives nothing for it.
    """
    item = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
    long = rows.select(*keys, F.col(language).alias("_l"), F.col(path).alias("_p"), "completeness", F.explode(F.array(*[item(m) for m in metrics])).alias("x")).select(*keys, "_l", "_p", "completeness", "x.*")
    both = long.join(authored(rules), "metric")
    selected = ((F.size("languages") == 0) | F.coalesce(F.array_contains("languages", F.lower("_l")), F.lit(False))) & (F.col("admit").isNull() | F.regexp_like("_p", "admit")) & ~F.coalesce(F.regexp_like("_p", "refuse"), F.lit(False))
    return _judged(both.where(selected), keys)


def unknown_subjects(rules: DataFrame, subjects: DataFrame, subject: str) -> DataFrame:
    """Subjects that rules name and the run doesn't have: ``(rule_id, subject)``."""
    named = rules.select("rule_id", F.explode("subjects").alias(subject)).distinct()
    return named.join(subjects.select(subject).distinct(), subject, "left_anti").select("rule_id", subject)


def integrity(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Rules about a run itself, one row a group and rule: ``violated`` if any row breaks it, with how many do."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in conditions.items()])
    item = lambda r: F.struct(F.lit(r).alias("rule_id"), F.col(r).alias("rows"), F.when(F.col(r) > 0, "violated").otherwise("passed").alias("status"))
    return counts.select(*by, F.explode(F.array(*[item(r) for r in conditions])).alias("x")).select(*by, "x.*")


def tallies(findings: DataFrame) -> DataFrame:
    """Counts per rule and status, every status a column."""
    return findings.groupBy("rule_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def collapse(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that can't be judged as one finding a reason, with their number."""
    return findings.where(F.col("status") == "not_evaluable").groupBy("rule_id", *keys, "reason").agg(F.count("*").alias("n"))


def ratchet(baseline: DataFrame, current: DataFrame, keys: list[str], *, worse: str = "increase", allowed: float = 0.0) -> DataFrame:
    """Current values against a baseline, by exact key.

    ``baseline``: (*keys, value); ``current``: (*keys, value, completeness).  unchanged, improved, tolerated or
    regression by the signed difference; a current value that isn't complete gives its completeness, a missing row
    ``missing`` and a row without baseline ``extra``.
    """
    b = baseline.select(*keys, F.col("value").alias("baseline"), F.lit(True).alias("_b"))
    c = current.select(*keys, F.col("value").alias("current"), "completeness", F.lit(True).alias("_c"))
    delta = F.col("current") - F.col("baseline")
    signed = delta if worse == "increase" else -delta
    decision = (
        F.when(F.col("_b").isNull(), "extra").when(F.col("_c").isNull(), "missing").when(F.col("completeness") != "complete", F.col("completeness"))
        .when(signed.isNull(), "unavailable").when(signed == 0, "unchanged").when(signed < 0, "improved").when(signed <= allowed, "tolerated").otherwise("regression")
    )
    return b.join(c, keys, "full").select(*keys, "baseline", "current", delta.alias("delta"), decision.alias("decision"))


def observations(df: DataFrame, keys: list[str], metrics: dict[str, Column], completeness: Column) -> DataFrame:
    """Observed values as coordinates: ``(*keys, metric, value, completeness)``, one row a metric, absent ones included."""
    item = lambda m, c: F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value"))
    return df.select(*keys, completeness.alias("completeness"), F.explode(F.array(*[item(m, c) for m, c in metrics.items()])).alias("x")).select(*keys, "x.metric", "x.value", "completeness")


def capture(observed: DataFrame, keys: list[str]) -> DataFrame:
    """A baseline: complete values only, each with the digest of its coordinate and value."""
    rows = observed.where((F.col("completeness") == "complete") & F.col("value").isNotNull())
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in [*keys, "metric"]]
    return rows.select(*keys, "metric", "value", digest(*parts, canonical_number(F.col("value")), prefix="sha256:").alias("coordinate"))


def admission(baseline: DataFrame, current: DataFrame, keys: list[str], contracts: list[str]) -> DataFrame:
    """Whether a baseline may be compared: ``(*keys, decision)``; unpaired keys and differing contracts are told, never guessed."""
    b = baseline.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in contracts], F.lit(True).alias("_b"))
    c = current.select(*keys, *[F.col(x).alias(f"_c_{x}") for x in contracts], F.lit(True).alias("_c"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_b_{x}").eqNullSafe(F.col(f"_c_{x}")), F.lit(x)) for x in contracts]))
    decision = F.when(F.col("_b").isNull(), "no_baseline").when(F.col("_c").isNull(), "no_current").when(F.size(differs) > 0, F.concat(F.lit("incompatible:"), F.array_join(differs, ","))).otherwise("admitted")
    return b.join(c, keys, "full").select(*keys, decision.alias("decision"))
