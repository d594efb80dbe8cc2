"""The run log as a stream: new JSON-line files of a folder, counted by severity and module.

The only stream there is comes from append-only log files; counts are kept with a watermark on event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp timestamp, severity string, module string, message string, repository_url string, commit_sha string, error_type string"


def log_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def severity_counts(log: DataFrame, *, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per window; works on a stream and on a table alike."""
    rows = log.withWatermark("timestamp", late) if log.isStreaming else log
    counts = rows.groupBy(F.window("timestamp", window).alias("w"), "severity", "module").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "severity", "module", "n")
