"""Documents written by hand or standing beside a run: policies, baselines and evidence, read with their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule_id string, metric string, operator string, threshold double, severity string, scope string, partial_data string, languages array<string>, admit string, refuse string, subjects array<string>"
WAIVER = "waiver_id string, rule_id string, subject string, expires_on date, reason string"
POLICY = f"policy_format string, name string, rules array<struct<{', '.join(f.replace(' ', ': ', 1) for f in RULE.split(', '))}>>, waivers array<struct<{', '.join(f.replace(' ', ': ', 1) for f in WAIVER.split(', '))}>>"
#: Metrics that rules may name (fixed values).
METRICS = ("lines_of_code", "callable_count", "files", "classes_structs", "methods_functions", "cyclomatic", "cognitive", "max_nesting", "nloc", "parameters", "attention", "occurrences")
OPERATORS = ("gt", "gte", "lt", "lte", "eq", "ne")


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256, text)`` of standing documents, as they lie there."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def policy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules and waivers of a policy document, in the order they were written (``place``); a document that isn't of the form fails the read."""
    document = spark.read.json(path, schema=POLICY, mode="FAILFAST", multiLine=True)
    rules = document.select(F.posexplode("rules").alias("place", "r")).select("place", "r.*")
    return rules, document.select(F.posexplode("waivers").alias("place", "w")).select("place", "w.*")


def rule_faults(rules: DataFrame) -> DataFrame:
    """Rules that can't be judged: ``(rule_id, fault)``; metrics and operators are closed vocabularies, ids are unique."""
    twice = rules.groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1").select("rule_id", F.lit("repeated_id").alias("fault"))
    faults = F.array_compact(F.array(F.when(~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)), "unknown_metric"), F.when(~F.coalesce(F.col("operator").isin(*OPERATORS), F.lit(False)), "unknown_operator"), F.when(F.col("threshold").isNull(), "no_threshold")))
    return rules.select("rule_id", F.explode(faults).alias("fault")).unionByName(twice)


def baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Observations of a baseline, JSON lines of one schema; anything else fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def plain_list(spark: SparkSession, path: str) -> DataFrame:
    """Locations of plain list files, one a line, comments and blanks left out: ``(url, file, label)``."""
    from sievework.operators.inputs import label_of_list

    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("url"), F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"))
    return lines.where("url <> ''").withColumn("label", label_of_list(F.col("file")))
