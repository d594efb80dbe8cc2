"""The general training-data queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.orphans import Target, orphan_references, orphan_report
from sievework.operators.packed import split_packed
from sievework.operators.snapshots import snapshot_changes
from sievework.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "legacy_cell_recovery"), "cell_id", {"raw": "raw", "column_name": "column_name"})


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    targets = [
        Target("error_reference", table(spark, d, "errors"), "error_id", "recorded_at", "deleted_at"),
        Target("recovery_reference", table(spark, d, "recoveries"), "recovery_id", "recorded_at", "deleted_at"),
    ]
    return orphan_references(table(spark, d, "contributions"), "contribution_id", "recorded_at", targets)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("id").alias("contribution_id"), "field", "reason")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), tables={"error_reference": "errors", "recovery_reference": "recoveries"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshot_changes(
        table(spark, d, "contributions"),
        group=["workspace_id", "subject_key"],
        run="run_id",
        sequence="run_seq",
        path="relative_path",
        digest="content_sha256",
        arrived="ingested_at",
    )
    return changes.select(F.col("run").alias("run_id"), "subject_key", F.col("path").alias("relative_path"), "change_kind")


# A token is a word, or a quoted element with the word before it; a letter that touches the quote belongs to the notation.
_P1_TOKEN = r"""([A-Za-z0-9_./-]*?)[A-Za-z]?("(?:[^"\\]|\\.|"")*"?|'(?:[^'\\]|\\.|'')*'?)|[A-Za-z0-9_./-]+""".replace("'", "''")
_P1 = rf"""
WITH cells AS (SELECT DISTINCT cell_id, raw, column_name FROM legacy_cell_recovery),
texts AS (SELECT cell_id, 'raw' AS field, raw AS cell FROM cells UNION ALL SELECT cell_id, 'column_name', column_name FROM cells),
tokens AS (SELECT cell_id, field, regexp_extract_all(cell, '(?s){_P1_TOKEN}') AS ts FROM texts WHERE cell IS NOT NULL),
parts AS (SELECT cell_id, field, flatten(list_transform(ts, lambda t: CASE WHEN regexp_matches(t, '["'']')
  THEN [regexp_extract(t, '(?s)^{_P1_TOKEN}', 1), regexp_extract(t, '(?s)^{_P1_TOKEN}', 2)] ELSE [t] END)) AS ps FROM tokens),
bodies AS (SELECT cell_id, field, list_filter(list_transform(ps, lambda p: CASE WHEN left(p, 1) IN ('"', '''') THEN array_to_string(list_transform(
  regexp_extract_all(CASE WHEN length(p) > 1 AND right(p, 1) = left(p, 1) THEN p[2:-2] ELSE p[2:] END, '(?s)\\u[0-9a-fA-F]{{4}}|\\x[0-9a-fA-F]{{2}}|\\.|""|''''|.'), lambda e: CASE
    WHEN left(e, 2) IN ('\u', '\x') AND length(e) > 2 THEN chr(('0x' || e[3:])::INT) WHEN e = '\n' THEN chr(10) WHEN e = '\t' THEN chr(9) WHEN e = '\r' THEN chr(13) WHEN e = '\b' THEN chr(8) WHEN e = '\f' THEN chr(12)
    WHEN e IN ('\\', '\"', '\''', '\/') THEN e[2:] WHEN e = p[1:1] || p[1:1] THEN p[1:1] ELSE e END), '') ELSE p END), lambda v: v <> '') AS vs FROM parts)
SELECT cell_id, field, (unnest(generate_series(1, len(vs))) - 1)::INT AS pos, unnest(vs) AS val FROM bodies
"""

_P2 = """
WITH refs AS (
  SELECT DISTINCT contribution_id, field, lower(trim(key)) AS key, recorded_at AS t FROM (
    SELECT contribution_id, 'error_reference' AS field, error_reference AS key, recorded_at FROM contributions
    UNION ALL SELECT contribution_id, 'recovery_reference', recovery_reference, recorded_at FROM contributions)
  WHERE key IS NOT NULL AND lower(trim(key)) NOT IN ('', 'none', 'n/a', '-')),
targets AS (
  SELECT 'error_reference' AS field, lower(trim(error_id)) AS key, recorded_at, deleted_at FROM errors
  UNION ALL SELECT 'recovery_reference', lower(trim(recovery_id)), recorded_at, deleted_at FROM recoveries),
judged AS (
  SELECT contribution_id, r.field, r.t, count(g.key) AS n, min(g.recorded_at) AS first,
         coalesce(bool_or(g.recorded_at <= r.t AND (g.deleted_at IS NULL OR g.deleted_at > r.t)), false) AS holds
  FROM refs r LEFT JOIN targets g ON r.field = g.field AND r.key = g.key GROUP BY ALL),
found AS (
  SELECT contribution_id, field, t, CASE WHEN n = 0 THEN 'missing' WHEN first > t THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE NOT holds)
"""

_P5 = """
WITH rows_ AS (
  SELECT workspace_id, subject_key, run_id, run_seq, ingested_at,
         array_to_string(list_filter(string_split(replace(relative_path, '\\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/') AS path,
         ltrim(lower(content_sha256), '0') AS digest
  FROM contributions),
runs AS (
  SELECT *, row_number() OVER w AS k, lead(run_id) OVER w AS next_run
  FROM (SELECT workspace_id, subject_key, run_id, min(run_seq) AS run_seq FROM rows_ GROUP BY ALL)
  WINDOW w AS (PARTITION BY workspace_id, subject_key ORDER BY run_seq, run_id)),
files AS (
  SELECT r.workspace_id, r.subject_key, path, k, next_run, r.run_id, arg_max(digest, ingested_at) AS digest, count(digest) AS known
  FROM rows_ r JOIN runs USING (workspace_id, subject_key, run_id) GROUP BY ALL),
pairs AS (
  SELECT coalesce(b.run_id, a.next_run) AS run_id, coalesce(a.subject_key, b.subject_key) AS subject_key, coalesce(a.path, b.path) AS relative_path,
         CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
              WHEN a.digest <> b.digest THEN 'changed' END AS change_kind, b.k AS bk
  FROM files a FULL JOIN files b ON a.workspace_id = b.workspace_id AND a.subject_key = b.subject_key AND a.path = b.path AND b.k = a.k + 1)
SELECT DISTINCT run_id, subject_key, relative_path, change_kind FROM pairs
WHERE change_kind IS NOT NULL AND run_id IS NOT NULL AND (change_kind <> 'added' OR bk > 1)
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_found": _P2 + "SELECT contribution_id, field, reason FROM found",
        "p2_report": _P2
        + """SELECT CASE field WHEN 'error_reference' THEN 'errors' ELSE 'recoveries' END AS table_name,
        date_trunc('week', t) AS period, reason, count(*) AS n FROM found GROUP BY ALL""",
        "p5_found": _P5,
    }
