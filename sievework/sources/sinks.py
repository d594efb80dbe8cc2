"""Sinks: partitioned ledgers, run directories committed by their status row, CSV, JSON lines and SARIF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ledger(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet, one directory a key.  Rows are spread by key and a salt, so a key with a third of all rows isn't one task's work."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(parts, *[F.col(b) for b in by], salt).write.partitionBy(*by).mode("errorifexists").parquet(path)


#: Up to so many rows a ledger is one file (fixed value of the format).
SINGLE_FILE_ROWS = 50_000


def write_laid_out(df: DataFrame, path: str, by: list[str]) -> str:
    """A ledger in its format's layout: one file up to ``SINGLE_FILE_ROWS`` rows, else one directory a key.  Says which."""
    if df.limit(SINGLE_FILE_ROWS + 1).count() <= SINGLE_FILE_ROWS:
        df.coalesce(1).sortWithinPartitions(*by).write.mode("errorifexists").parquet(path)
        return "single"
    write_ledger(df, path, by)
    return "partitioned"


def schema_document(df: DataFrame) -> dict[str, str]:
    """Names and types of a table, for export beside it."""
    return dict(df.dtypes)


def schema_violations(df: DataFrame, schema: dict[str, str], required: list[str]) -> list[str]:
    """What a table lacks or has too much against a schema, by name; rows aren't read."""
    have = dict(df.dtypes)
    return sorted([f"missing:{c}" for c in schema if c not in have] + [f"unknown:{c}" for c in have if c not in schema] + [f"type:{c}" for c in schema if have.get(c, schema[c]) != schema[c]] + [f"required:{c}" for c in required if c not in have])


def required_violations(df: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """Rows in which a required field is missing: ``(*key, field)``."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.select(*key, F.explode(missing).alias("field"))


def finalize_run(spark: SparkSession, directory: str, tables: dict[str, DataFrame], checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> None:
    """Write every table, hold the written tables against the checks, and commit the status row last.

    A check gives the offending rows; any row leaves the run without a status, so no reader opens it.
    """
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{directory}/{name}")
    written = {name: spark.read.parquet(f"{directory}/{name}") for name in tables}
    broken = [name for name, check in checks.items() if check(written).limit(1).count()]
    if broken:
        raise ValueError("checks failed: " + ", ".join(sorted(broken)))
    status = spark.createDataFrame([("complete", len(tables))], "state string, tables int").withColumn("finished_at", F.current_timestamp())
    status.coalesce(1).write.mode("errorifexists").parquet(f"{directory}/status")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue='""', escape='"')


def canonical_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, keys sorted, NULLs kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def append_log(df: DataFrame, path: str) -> None:
    canonical_json(df).write.mode("append").text(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF 2.1.0 results, one a finding: ``findings`` has rule_id, severity, message, path and start_line."""
    level = F.when(F.col("severity") == "violation", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(
        F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("path").isNotNull(), F.array(place)).alias("locations"))).alias("value")
    )
