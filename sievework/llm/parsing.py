"""Source files that do not parse: every file through the parser of its language.

Files are spread evenly over the cluster before they are parsed, since parsing costs far more than moving the
text, and are parsed one Arrow batch at a time.  All errors are kept; the first one is the cause.

Defined results
---------------
* A file of nothing but blanks and comments is valid, and so is an empty text.
* A null text, a null language or one without a parser gives no verdict (``valid`` is NULL).
* Nesting beyond what a parser can follow counts as not parsed.
* Rows repeated as a whole come out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.syntax import LANGUAGES, Problem, check

_ERROR = pa.struct([("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())])


def judge(text: str | None, language: str | None, path: str | None) -> list[Problem] | None:
    """All errors of a file, or None without a verdict."""
    return None if text is None or language not in LANGUAGES else check(text, language, path or "")


def parse_files(df: DataFrame, keep: list[str], *, text: str, language: str, path: str) -> DataFrame:
    """``(*keep, valid, cause, errors)``; ``cause`` is the first error's message, ``errors`` all in source order."""
    kinds = dict(df.dtypes)
    n = len(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[Problem] | None] = {}  # copies of a file are parsed once a task
        for batch in batches:
            found = []
            for row in zip(*(batch.column(n + i).to_pylist() for i in range(3))):
                key = (*row[:2], (row[2] or "").lower().rpartition("/")[2].partition(".")[2])
                if key not in known:
                    if len(known) >= 2000:
                        known.clear()
                    known[key] = judge(*row)
                found.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:n],
                    pa.array([None if e is None else not e for e in found], pa.bool_()),
                    pa.array([e[0].message if e else None for e in found], pa.string()),
                    pa.array([None if e is None else [p._asdict() for p in e] for e in found], pa.list_(_ERROR)),
                ],
                names=[*keep, "valid", "cause", "errors"],
            )

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(*keep, *[F.col(c).alias(f"_{i}") for i, c in enumerate((text, language, path))]).repartition(parts, F.xxhash64(*keep))
    columns = ", ".join(f"{k} {kinds[k]}" for k in keep)
    return spread.mapInArrow(scan, f"{columns}, valid boolean, cause string, errors array<struct<line: int, column: int, message: string>>").distinct()


def parse_rates(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Files, invalid files and their share per group; files without a verdict don't count."""
    judged = parsed.where(F.col("valid").isNotNull()).groupBy(*by)
    counts = judged.agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return counts.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
