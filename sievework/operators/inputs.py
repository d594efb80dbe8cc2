"""The input ledger: which subjects a run was asked to look at, and what became of each row.

Every accepted row stays in the ledger.  Of rows with one location the first is the representative and the others are
duplicates of it; rows that say different things about one location are conflicts, reported and never silently resolved.

Defined results
---------------
* A null or blank location, an unknown language or flag, and a revision that is no hexadecimal number of 7 to 40 digits
  make a row invalid; its problems come out as a list and it takes no part in what follows.
* Locations compare without regard to case; ties of order are broken by the row's own columns.
* An empty input gives empty results; further columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.numbers import lenient_boolean
from sievework.functions.text import digest

LANGUAGES = ("Java", "JavaScript", "TypeScript", "Python", "Go")


def canonical_url(url: Column) -> Column:
    """``https://host/owner/name`` of a web or shell location of two segments; NULL for anything else."""
    form = r"^(?:https?://(?:www\.)?|git@|ssh://git@)([A-Za-z0-9.-]+)[/:]([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    part = lambda i: F.regexp_extract(F.trim(url), form, i)
    return F.when(part(3) != "", F.concat(F.lit("https://"), F.lower(part(1)), F.lit("/"), part(2), F.lit("/"), part(3)))


def canonical_language(language: Column) -> Column:
    plain = F.lower(F.trim(language))
    return F.coalesce(*[F.when(plain == x.lower(), x) for x in LANGUAGES])


def parse_rows(df: DataFrame, *, url: str, language: str, sha: str, enabled: str | None = None) -> DataFrame:
    """``df`` with ``canonical_url``, ``expected_language``, ``requested_sha``, ``enabled`` and ``problems``, a list."""
    flag = F.col(enabled).cast("string") if enabled else F.lit("")
    blank = F.coalesce(F.trim(flag), F.lit("")) == ""
    commit = F.nullif(F.lower(F.trim(F.col(sha))), F.lit(""))
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "missing_url").when(canonical_url(F.col(url)).isNull(), "wrong_url"),
        F.when((F.coalesce(F.trim(language), F.lit("")) != "") & canonical_language(F.col(language)).isNull(), "unknown_language"),
        F.when(~F.coalesce(commit.rlike("^[0-9a-f]{7,40}$"), F.lit(True)), "wrong_sha"), F.when(~blank & lenient_boolean(flag).isNull(), "wrong_flag"),
    ))
    return df.withColumns({
        "canonical_url": canonical_url(F.col(url)), "expected_language": canonical_language(F.col(language)), "requested_sha": commit,
        "enabled": F.when(blank, F.lit(True)).otherwise(lenient_boolean(flag)), "problems": problems,
    })


def ledger(parsed: DataFrame, scope: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Valid rows with ``duplicate`` (unique, representative, identical), ``representative_row``, ``conflict`` and ``disposition``.

    ``fields`` are what equal locations have to agree on.  One window a location; its rows are copies and few.
    """
    same = Window.partitionBy(*scope, "_key")
    said = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rows = parsed.where(F.size("problems") == 0).withColumn("_key", F.lower("canonical_url")).withColumn("_said", said)
    rows = rows.withColumn("_place", F.row_number().over(same.orderBy(*order, "_said"))).withColumn("_n", F.count("*").over(same))
    first = F.min_by(F.struct(*order), "_place").over(same)
    rows = rows.withColumn("conflict", F.min("_said").over(same) != F.max("_said").over(same))
    kind = F.when(F.col("_n") == 1, "unique").when(F.col("_place") == 1, "representative").otherwise("identical")
    rows = rows.withColumns({"duplicate": kind, "representative_row": F.when(F.col("_place") > 1, first[order[0]])})
    disposition = F.when(F.col("conflict"), "refused_conflict").when(F.col("duplicate") == "identical", "skipped_duplicate").when(~F.col("enabled"), "skipped_disabled").otherwise("pending")
    return rows.withColumn("disposition", disposition).drop("_key", "_said", "_place", "_n")


def apply_outcomes(rows: DataFrame, outcomes: DataFrame, scope: list[str]) -> DataFrame:
    """What a run did, folded back: ``outcomes`` has (*scope, canonical_url, resolved_sha, analyzed_sha, verification, status).

    A duplicate is left alone; the requested revision is never overwritten; no analysed revision and a failed status is a
    failed acquisition.
    """
    o = outcomes.select(*scope, "canonical_url", F.coalesce("resolved_sha", "analyzed_sha").alias("resolved_sha"), "analyzed_sha", "verification", "status")
    both = rows.join(o, [*scope, "canonical_url"], "left")
    takes = (F.col("disposition") == "pending") & F.col("status").isNotNull()
    failed = (F.col("status") == "failed") & F.col("analyzed_sha").isNull()
    both = both.withColumn("disposition", F.when(takes & failed, "failed_acquisition").when(takes, "executed").otherwise(F.col("disposition")))
    ran = F.col("disposition").isin("executed", "failed_acquisition")
    return both.withColumns({c: F.when(ran, F.col(c)) for c in ("resolved_sha", "analyzed_sha", "verification")}).withColumn("measured", F.col("disposition") == "executed").drop("status")


def frozen_rows(rows: DataFrame) -> DataFrame:
    """Rows that can be run again byte for byte: a verified analysed revision, duplicates left out."""
    return rows.where((F.col("duplicate") != "identical") & F.col("analyzed_sha").isNotNull() & (F.col("verification") == "verified")).withColumn("commit_sha", F.col("analyzed_sha"))


def retry_rows(rows: DataFrame) -> DataFrame:
    """Rows to try again: what ran or failed to be acquired, at the analysed revision or else the requested one."""
    return rows.where("enabled and duplicate <> 'identical' and disposition in ('executed', 'failed_acquisition')").withColumn("commit_sha", F.coalesce("analyzed_sha", "requested_sha", F.lit("")))


def input_hash(files: DataFrame, by: list[str], digest_col: str) -> DataFrame:
    """One hash of several input files, whatever their order; a group's files are few."""
    return files.groupBy(*by).agg(digest(F.array_join(F.array_sort(F.collect_list(digest_col)), "\n")).alias("input_hash"), F.count("*").alias("files"))


def label_of_list(name: Column) -> Column:
    """Architecture label from the name of a plain list file."""
    lower = F.lower(name)
    return F.when(lower.contains("microservice"), "microservices").when(lower.contains("monolith"), "monolith").otherwise("unknown")
