"""Schema drift over the two drifting test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.drift import TYPES, ingest, promote, schema_changes, type_of, with_header
from sievework.session import table

#: Target schema of each table and the other names approved for its columns.
METRICS = {
    "repository_url": "string", "architecture_type": "string", "execution_mode": "string", "program_version": "string", "exclusion_policy_version": "string",
    "inventory_schema_version": "string", "lines_of_code": "bigint", "source_files": "bigint", "classes_structs": "bigint", "methods_functions": "bigint",
    "metric_status": "string", "inventory_status": "string", "loc_status": "string", "source_files_readable": "bigint", "source_files_failed_read": "bigint",
    "source_files_oversized": "bigint", "source_files_failed_parse": "bigint", "expected_language_mismatch": "boolean",
}
METRIC_NAMES = {
    "lines_of_code": ["loc", "code_line_total"], "source_files": ["files_total", "sourceFiles"], "classes_structs": ["types_total"],
    "methods_functions": ["callables_total"], "repository_url": ["source_key"],
}
#: Fields that came later and were approved as columns of their own.
METRICS_LATER = {
    "comment_ratio": "double", "usability_reason_codes": "array<string>", "benchmark_usability": "string", "qualification_status": "string",
    "repository_representativeness": "string", "repository_level_comparison_eligible": "boolean", "analysis_scope_hash": "string", "analysis_scope_hash_version": "string",
}
ERRORS = {
    "repository_url": "string", "severity": "string", "error_type": "string", "error_category": "string", "file_path": "string", "detected_language": "string",
    "root_has_error": "string", "first_error_start_line": "string", "affected_metrics": "string", "message": "string",
}
ERROR_NAMES = {
    "repository_url": ["subject_key"], "error_category": ["category"], "file_path": ["relative_path"],
    "first_error_start_line": ["start_line"], "message": ["diagnostic", "detail"],
}
ERRORS_LATER = {"stage": "string", "fallback_attempted": "string", "fallback_strategies": "string"}
CELLS = [f"c{i}" for i in range(14)]


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    # Only a record with a commit is the same record in two runs.
    parts = ["subject_key", "detected_language", "analyzed_commit_sha"]
    key = F.when(F.col("subject_key").isNotNull() & F.col("detected_language").isNotNull() & F.col("analyzed_commit_sha").isNotNull(), F.to_json(F.array(*parts)))
    return table(spark, d, "language_metrics").withColumn("record", key)


def _error_rows(spark: SparkSession, d: str) -> DataFrame:
    return with_header(table(spark, d, "errors"), CELLS, stream=["workspace_id"], run="run_id", line="line_no", arrived="recorded_at", record="error_id", rest=["run_seq", "line_no", "deleted_at"])


def _text_type(bits):
    """boolean if all filled cells are, integer if all are, else string."""
    return F.when(bits == 1 << TYPES.index("boolean"), "boolean").when(bits == 1 << TYPES.index("integer"), "integer").when(bits != 0, "string")


def _file_type(bits):
    return F.when(F.col("table_name") == "errors", _text_type(bits)).otherwise(type_of(bits))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # Both tables go through one plan, told apart by their name.
    columns = ["table_name", "workspace_id", "run_id", "run_seq", "record", "arrived", "body", "is_text", "header"]
    none = F.lit(None).cast("array<string>")
    metrics = _metric_rows(spark, d).select(F.lit("language_metrics").alias("table_name"), "workspace_id", "run_id", "run_seq", "record", F.col("ingested_at").alias("arrived"), F.col("record_json").alias("body"), F.lit(False).alias("is_text"), none.alias("header"))
    errors = _error_rows(spark, d).select(F.lit("errors").alias("table_name"), "workspace_id", "run_id", "run_seq", F.col("error_id").alias("record"), F.col("recorded_at").alias("arrived"), F.col("record_json").alias("body"), F.lit(True).alias("is_text"), "header")
    rows = metrics.select(columns).unionByName(errors.select(columns))
    changes = schema_changes(rows, stream=["table_name", "workspace_id"], run="run_id", sequence="run_seq", record="record", arrived="arrived", body="body", text="is_text", header="header", file_type=_file_type)
    return changes.select("table_name", F.col("run").alias("run_id"), "old_field", "new_field", "change_kind")


def p4_language_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table: typed columns, later fields promoted, whatever is left as JSON.

    Declared versions are missing, untidy and not in step with the fields, so they decide nothing.
    """
    target = METRICS | METRICS_LATER
    keep = ["workspace_id", "run_id", "run_seq", "subject_key", "detected_language", "analyzed_commit_sha", "ingested_at"]
    wide = ingest(table(spark, d, "language_metrics"), "record_json", METRICS, keep).drop("_seen")
    for f, t in METRICS_LATER.items():
        wide = wide.withColumn(f, F.lit(None).cast(t))
    out = promote(wide, target, METRIC_NAMES).distinct()
    return out.select("workspace_id", "run_id", "run_seq", "subject_key", "detected_language", "analyzed_commit_sha", "ingested_at", *target, F.col("_rescued").alias("rescued"))


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of error lines, in the column names of the first files."""
    target = ERRORS | ERRORS_LATER
    keep = ["workspace_id", "run_id", "run_seq", "line_no", "recorded_at", "deleted_at", "error_id"]
    wide = ingest(_error_rows(spark, d).where(F.col("record_json").isNotNull()), "record_json", ERRORS, keep).drop("_seen")
    for f, t in ERRORS_LATER.items():
        wide = wide.withColumn(f, F.lit(None).cast(t))
    wide = promote(wide, target, ERROR_NAMES)
    truth = F.lower(F.trim("root_has_error"))
    wide = wide.withColumn("root_has_error", F.when(truth.isin("true", "1"), True).when(truth.isin("false", "0"), False))
    wide = wide.withColumn("first_error_start_line", F.trim("first_error_start_line").try_cast("bigint"))
    return wide.select("workspace_id", "run_id", "run_seq", "line_no", "error_id", "recorded_at", "deleted_at", *target, F.col("_rescued").alias("rescued")).distinct()


#: The definition, read literally: fields of each file, gone and new ones, and their values over the records of both files.
_P4 = """
WITH heads AS (SELECT workspace_id, run_id, arg_max([""" + ", ".join(f"coalesce({c}, '')" for c in CELLS) + """], recorded_at) AS h FROM errors WHERE line_no = 0 GROUP BY ALL),
named AS (SELECT workspace_id, run_id, list_transform(h, lambda c: lower(regexp_replace(c, '^[\\s\\x{feff}]+|[\\s\\x{feff}]+$', '', 'g'))) AS n FROM heads),
cells AS (SELECT DISTINCT e.workspace_id, e.run_id, e.run_seq, e.error_id AS record, e.recorded_at AS arrived, e.line_no, n, unnest(generate_series(1, 14)) AS i, [""" + ", ".join(CELLS) + """] AS cs FROM errors e JOIN named USING (workspace_id, run_id)),
e AS (SELECT 'errors' AS t, workspace_id, run_id, run_seq, record, arrived, n[i] AS field, CASE WHEN line_no > 0 THEN nullif(cs[i], '') END AS v FROM cells WHERE n[i] <> '' AND list_position(n, n[i]) = i),
ek AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN lower(trim(v, ' ')) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(trim(v, ' '), '^[+-]?[0-9]+$') THEN 'integer' ELSE 'string' END AS kind FROM e),
m AS (SELECT workspace_id, run_id, run_seq, CASE WHEN analyzed_commit_sha IS NOT NULL THEN subject_key || '|' || detected_language || '|' || analyzed_commit_sha END AS record, ingested_at AS arrived, record_json AS j, unnest(json_keys(record_json)) AS field FROM (SELECT DISTINCT * FROM language_metrics)),
mk AS (SELECT 'language_metrics' AS t, workspace_id, run_id, run_seq, record, arrived, field, nullif(json_type(j, '$."' || field || '"'), 'NULL') AS jt, json_extract(j, '$."' || field || '"')::VARCHAR AS v FROM m),
kv AS (SELECT t, workspace_id, run_id, run_seq, record, arrived, field, v, kind FROM ek UNION ALL SELECT t, workspace_id, run_id, run_seq, record, arrived, field, CASE WHEN jt IS NOT NULL THEN v END,
 CASE jt WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END FROM mk),
seqs AS (SELECT t, workspace_id, run_id, min(run_seq) AS s FROM (SELECT 'errors' AS t, workspace_id, run_id, run_seq FROM errors SEMI JOIN heads USING (workspace_id, run_id) UNION ALL SELECT 'language_metrics', workspace_id, run_id, run_seq FROM language_metrics) GROUP BY ALL),
runs AS (SELECT *, row_number() OVER (PARTITION BY t, workspace_id ORDER BY s, run_id) AS k FROM seqs),
steps AS (SELECT a.t, a.workspace_id, a.run_id AS r0, b.run_id AS r1 FROM runs a JOIN runs b ON a.t = b.t AND a.workspace_id = b.workspace_id AND a.k + 1 = b.k),
f AS (SELECT t, workspace_id, run_id, field, list_sort(list_distinct(list(kind) FILTER (kind IS NOT NULL))) AS kinds FROM kv GROUP BY ALL),
ft AS (SELECT t, workspace_id, run_id, field, CASE WHEN len(coalesce(kinds, [])) = 0 THEN NULL WHEN t = 'errors' THEN CASE WHEN len(kinds) = 1 THEN kinds[1] ELSE 'string' END WHEN kinds = ['integer', 'number'] THEN 'number' ELSE array_to_string(kinds, '|') END AS type FROM f),
gone AS (SELECT s.*, x.field FROM steps s JOIN ft x ON x.t = s.t AND x.run_id = s.r0 AND x.workspace_id = s.workspace_id WHERE NOT EXISTS (SELECT 1 FROM ft y WHERE y.t = s.t AND y.run_id = s.r1 AND y.workspace_id = s.workspace_id AND y.field = x.field)),
came AS (SELECT s.*, x.field FROM steps s JOIN ft x ON x.t = s.t AND x.run_id = s.r1 AND x.workspace_id = s.workspace_id WHERE NOT EXISTS (SELECT 1 FROM ft y WHERE y.t = s.t AND y.run_id = s.r0 AND y.workspace_id = s.workspace_id AND y.field = x.field)),
latest AS (SELECT t, workspace_id, run_id, record, max(arrived) AS arrived FROM kv WHERE record IS NOT NULL GROUP BY ALL),
vals AS (SELECT t, workspace_id, run_id, record, field, max(coalesce(kind, '') || ':' || v) AS v FROM kv JOIN latest USING (t, workspace_id, run_id, record, arrived) GROUP BY ALL),
shared AS (SELECT s.*, a.record FROM steps s JOIN latest a ON a.t = s.t AND a.workspace_id = s.workspace_id AND a.run_id = s.r0 JOIN latest b ON b.t = s.t AND b.workspace_id = s.workspace_id AND b.run_id = s.r1 AND a.record = b.record),
o AS (SELECT g.t, g.workspace_id, g.r1, g.field, string_agg(p.record || '=' || coalesce(v.v, '~'), chr(30) ORDER BY p.record) AS sig FROM gone g JOIN shared p USING (t, workspace_id, r0, r1) LEFT JOIN vals v ON v.t = g.t AND v.workspace_id = g.workspace_id AND v.run_id = g.r0 AND v.record = p.record AND v.field = g.field GROUP BY ALL),
n AS (SELECT g.t, g.workspace_id, g.r1, g.field, string_agg(p.record || '=' || coalesce(v.v, '~'), chr(30) ORDER BY p.record) AS sig FROM came g JOIN shared p USING (t, workspace_id, r0, r1) LEFT JOIN vals v ON v.t = g.t AND v.workspace_id = g.workspace_id AND v.run_id = g.r1 AND v.record = p.record AND v.field = g.field GROUP BY ALL),
os AS (SELECT *, row_number() OVER (PARTITION BY t, workspace_id, r1, sig ORDER BY field) AS slot FROM o), ns AS (SELECT *, row_number() OVER (PARTITION BY t, workspace_id, r1, sig ORDER BY field) AS slot FROM n),
ren AS (SELECT t, workspace_id, r1, os.field AS old_field, ns.field AS new_field FROM os JOIN ns USING (t, workspace_id, r1, sig, slot))
SELECT t AS table_name, r1 AS run_id, old_field, new_field, 'renamed' AS change_kind FROM ren
UNION ALL SELECT t, r1, field, '', 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.t = g.t AND ren.workspace_id = g.workspace_id AND ren.r1 = g.r1 AND old_field = g.field)
UNION ALL SELECT t, r1, '', field, 'added' FROM came g WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.t = g.t AND ren.workspace_id = g.workspace_id AND ren.r1 = g.r1 AND new_field = g.field)
UNION ALL SELECT s.t, s.r1, x.field, x.field, 'type_changed' FROM steps s JOIN ft x ON x.t = s.t AND x.workspace_id = s.workspace_id AND x.run_id = s.r0 JOIN ft y ON y.t = s.t AND y.workspace_id = s.workspace_id AND y.run_id = s.r1 AND x.field = y.field WHERE x.type <> y.type
"""


def queries() -> dict:
    return {"p4_found": p4_found, "p4_language_metrics": p4_language_metrics, "p4_errors": p4_errors}


def oracle_sql() -> dict[str, str]:
    """Of the list of changes; the consistent tables are tested against brute force instead."""
    return {"p4_found": _P4}
