"""Queries of projections, diagnostics and explanations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.paths import path_fault
from sievework.operators import projection as P
from sievework.plans import evidence_queries as Q
from sievework.plans.evidence_queries import LANGUAGES, _sql_ledger
from sievework.plans.registry import Registry
from sievework.plans.source_queries import _by_k, _part
from sievework.session import table

R = Registry()
query = R.query
_SUBJECT = ["workspace_id", "subject_key", "run_id"]
_VALUES = ["lines_of_code", "callable_count"]


@query("""WITH p AS (SELECT DISTINCT relative_path AS path FROM contributions)
SELECT path, CASE WHEN path IS NULL OR path = '' THEN 'empty' WHEN contains(path, '\\') THEN 'backslash' WHEN starts_with(path, '/') THEN 'absolute' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive'
WHEN list_contains(string_split(path, '/'), '..') THEN 'parent_segment' WHEN list_contains(string_split(path, '/'), '.') THEN 'dot_segment' WHEN list_contains(string_split(path, '/'), '') THEN 'empty_segment' END AS fault FROM p""")
def path_faults(spark, d):
    return table(spark, d, "contributions").select(F.col("relative_path").alias("path")).distinct().select("path", path_fault(F.col("path")).alias("fault"))


@query("SELECT workspace_id, subject_key, run_id, " + ", ".join(f"sum(CASE WHEN detected_language = '{x}' THEN {v} END)::BIGINT AS {x.lower()}_{v}" for x in LANGUAGES for v in _VALUES) + f" FROM {_sql_ledger(*_SUBJECT, 'detected_language', *_VALUES)} GROUP BY ALL")
def catalogue(spark, d):
    return P.catalogue(Q._ledger(spark, d, *_SUBJECT, "detected_language", *_VALUES), _SUBJECT, "detected_language", _VALUES, list(LANGUAGES))


_ALLOWED = ["lines_of_code", "source_files", "metric_status", "repository_url"]


@query("""WITH r AS (SELECT DISTINCT workspace_id, run_id, subject_key, detected_language, record_json FROM language_metrics),
p AS (SELECT workspace_id, run_id, subject_key, detected_language, '{' || """ + " || ".join(f"CASE WHEN list_contains(json_keys(record_json), '{f}') THEN '\"{f}\":' || coalesce(to_json(CASE WHEN json_type(record_json, '$.{f}') <> 'NULL' THEN json_extract_string(record_json, '$.{f}') END)::VARCHAR, 'null') || ',' ELSE '' END" for f in sorted(_ALLOWED)) + """ AS t FROM r),
q AS (SELECT DISTINCT workspace_id, run_id, coalesce(subject_key, '') || chr(31) || coalesce(detected_language, '') || chr(31) || rtrim(t, ',') || '}' AS line FROM p), h AS (SELECT workspace_id, run_id, sha256(line) AS h FROM q),
i AS (SELECT workspace_id, run_id, h[1:2] AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY ALL)
SELECT workspace_id, run_id, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY b)) AS semantic_hash, sum(n)::BIGINT AS records FROM i GROUP BY ALL""")
def semantic_hash(spark, d):
    rows = table(spark, d, "language_metrics").select("workspace_id", "run_id", "subject_key", "detected_language", P.semantic_projection(F.col("record_json"), _ALLOWED).alias("projection"))
    return P.semantic_hash(rows, ["workspace_id", "run_id"], ["subject_key", "detected_language"], "projection")


_DIAGNOSTICS = f"""r AS (SELECT * FROM {_sql_ledger('workspace_id', 'run_id', 'relative_path', 'read_status', 'parse_status', 'recovery_strategy')}),
d AS (SELECT workspace_id, run_id, 'read_failure' AS category, relative_path AS detail, contribution_id FROM r WHERE read_status = 'failed' UNION ALL SELECT workspace_id, run_id, 'parse_failure', relative_path, contribution_id FROM r WHERE parse_status = 'failed'
UNION ALL SELECT workspace_id, run_id, 'recovered', recovery_strategy, contribution_id FROM r WHERE parse_status = 'recovered')
"""


def _diagnostics(spark, d):
    rows = Q._ledger(spark, d, "workspace_id", "run_id", "relative_path", "read_status", "parse_status", "recovery_strategy")
    parts = {"read_failure": (rows.where("read_status = 'failed'"), F.col("relative_path")), "parse_failure": (rows.where("parse_status = 'failed'"), F.col("relative_path")), "recovered": (rows.where("parse_status = 'recovered'"), F.col("recovery_strategy"))}
    return P.diagnostics(parts, ["workspace_id", "run_id", "contribution_id"])


@query("WITH " + _DIAGNOSTICS + "SELECT workspace_id, run_id, contribution_id, category, detail FROM d")
def run_diagnostics(spark, d):
    return _diagnostics(spark, d)


@query("WITH " + _DIAGNOSTICS + """, o AS (SELECT workspace_id, run_id, category, contribution_id, detail, row_number() OVER (w ORDER BY contribution_id) AS place, greatest(count(*) OVER w - 3, 0) AS left_out FROM d WINDOW w AS (PARTITION BY workspace_id, run_id, category))
SELECT workspace_id, run_id, category, contribution_id, detail[1:12] AS detail, place, left_out FROM o WHERE place <= 3""")
def capped_diagnostics(spark, d):
    """A report of the first diagnostics of each run and category, with how many were left out."""
    return P.capped(_diagnostics(spark, d), ["workspace_id", "run_id", "category"], [F.col("contribution_id")], "detail", rows=3, characters=12)


_STATE = "CASE WHEN count_if(nloc_status = 'failed') = count(*) THEN 'failed' WHEN count_if(nloc_status IN ('failed', 'partial')) > 0 THEN 'partial' ELSE 'complete' END"


@query(f"""WITH g AS (SELECT workspace_id, subject_key, run_id, detected_language AS l, sum(source_files_contribution) AS files, {_STATE} AS s FROM {_sql_ledger(*_SUBJECT, 'detected_language', 'source_files_contribution', 'nloc_status')} GROUP BY ALL),
e AS (SELECT *, CASE workspace_id % 4 WHEN 0 THEN ['JavaScript', 'TypeScript'] WHEN 1 THEN ['Python'] WHEN 2 THEN ['Go'] END AS family FROM g), m AS (SELECT *, coalesce(list_contains(family, l), false) AND files > 0 AS inside, s IN ('partial', 'failed') AND files > 0 AS bad FROM e)
SELECT workspace_id, subject_key, run_id, CASE WHEN bool_or(family IS NOT NULL) AND count_if(inside) > 0 THEN CASE max(CASE WHEN inside THEN CASE s WHEN 'complete' THEN 1 WHEN 'partial' THEN 2 WHEN 'failed' THEN 3 ELSE 0 END END) WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' WHEN 3 THEN 'failed' ELSE 'not_applicable' END ELSE 'not_applicable' END AS expected_status,
CASE WHEN bool_or(bad AND inside) AND bool_or(bad AND NOT inside) THEN 'multiple' WHEN bool_or(bad AND inside) THEN 'expected_language_family' WHEN bool_or(bad AND NOT inside) THEN 'secondary_supported_language_only' ELSE 'none' END AS partial_origin FROM m GROUP BY ALL""")
def expected_family(spark, d):
    failed, bad = F.count_if(F.col("nloc_status") == "failed"), F.count_if(F.col("nloc_status").isin("failed", "partial"))
    state = F.when(failed == F.count("*"), "failed").when(bad > 0, "partial").otherwise("complete")
    rows = Q._ledger(spark, d, *_SUBJECT, "detected_language", "source_files_contribution", "nloc_status").groupBy(*_SUBJECT, "detected_language").agg(F.sum("source_files_contribution").alias("files"), state.alias("status"))
    expected = F.when(F.col("workspace_id") % 4 == 0, "javascript").when(F.col("workspace_id") % 4 == 1, " Python").when(F.col("workspace_id") % 4 == 2, "GO")
    return P.family_status(expected, rows, _SUBJECT, "detected_language", "files", "status")


@query(f"""WITH r AS (SELECT *, detected_language IN ('JavaScript', 'TypeScript') AND source_files_contribution = 1 AS inc, coalesce(parse_status IN ('partial', 'failed'), false) AS bad FROM {_sql_ledger(*_SUBJECT, 'detected_language', 'source_files_contribution', 'parse_status', 'classes_structs')}),
g AS (SELECT workspace_id, subject_key, run_id, count_if(inc) AS n, count_if(inc AND bad) AS f, coalesce(sum(CASE WHEN inc THEN classes_structs END), 0)::BIGINT AS c FROM r GROUP BY ALL)
SELECT workspace_id, subject_key, run_id, CASE WHEN n = 0 THEN 'not_applicable' WHEN f > 0 AND c = 0 THEN 'parse_failures' WHEN c > 0 THEN 'classes_detected' WHEN n >= 5 THEN 'suspicious_zero' ELSE 'checked_no_classes_found' END AS status, n::BIGINT AS included, f::BIGINT AS failed, c AS classes FROM g""")
def script_audit(spark, d):
    rows = Q._ledger(spark, d, *_SUBJECT, "detected_language", "source_files_contribution", "parse_status", "classes_structs")
    included = F.coalesce(F.col("detected_language").isin("JavaScript", "TypeScript") & (F.col("source_files_contribution") == 1), F.lit(False))
    return P.audit_status(rows, _SUBJECT, included, F.coalesce(F.col("parse_status").isin("partial", "failed"), F.lit(False)), F.col("classes_structs"))


@query("SELECT p_partkey, (p_partkey % 12) < 4 AS python2 FROM part")
def python2_evidence(spark, d):
    text = _by_k(F.col("k"), ['print "x"', "if a:\n    print x, y", "try:\n    a()\nexcept E, e:\n    pass", "raise ValueError, 'x'", 'print("x")', "print = 3", "except (A, B):", "raise ValueError('a, b')", "print", "x = 'print y'", None, ""])
    return _part(spark, d).select("p_partkey", P.python2(text).alias("python2"))


@query(f"""WITH r AS (SELECT * FROM {_sql_ledger(*_SUBJECT, 'read_status', 'parse_status', 'lines_of_code')}), g AS (SELECT workspace_id, subject_key, run_id, count_if(read_status = 'failed') AS a, count_if(parse_status = 'failed') AS b, count_if(parse_status IN ('partial', 'recovered')) AS c FROM r GROUP BY ALL)
SELECT workspace_id, subject_key, run_id, CASE WHEN a > 0 THEN 'unread' WHEN b > 0 THEN 'unparsed' WHEN c > 0 THEN 'recovered' ELSE 'nothing_to_explain' END AS explanation, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END::BIGINT AS rows FROM g""")
def subject_explanations(spark, d):
    rows = Q._ledger(spark, d, *_SUBJECT, "read_status", "parse_status", "lines_of_code")
    return P.explain(rows, _SUBJECT, {"unread": F.col("read_status") == "failed", "unparsed": F.col("parse_status") == "failed", "recovered": F.col("parse_status").isin("partial", "recovered")})


@query("""WITH c AS (SELECT DISTINCT workspace_id, run_id, subject_key FROM contributions), r AS (SELECT DISTINCT workspace_id, run_id FROM contributions),
m AS (SELECT DISTINCT workspace_id, run_id, subject_key FROM language_metrics), v AS (SELECT DISTINCT recovery_id, workspace_id, run_id, subject_key FROM recoveries WHERE recovery_id IS NOT NULL),
e AS (SELECT DISTINCT workspace_id, run_id, line_no FROM errors WHERE line_no > 0), h AS (SELECT DISTINCT workspace_id, run_id FROM errors WHERE line_no = 0),
u AS (SELECT workspace_id, run_id, 'metrics_without_ledger' AS "check" FROM m ANTI JOIN c USING (workspace_id, run_id, subject_key) UNION ALL SELECT workspace_id, run_id, 'ledger_without_metrics' FROM c ANTI JOIN m USING (workspace_id, run_id, subject_key)
UNION ALL SELECT workspace_id, run_id, 'recovery_without_ledger' FROM v ANTI JOIN c USING (workspace_id, run_id, subject_key) UNION ALL SELECT workspace_id, run_id, 'error_line_without_header' FROM e ANTI JOIN h USING (workspace_id, run_id)
UNION ALL SELECT workspace_id, run_id, 'errors_without_run' FROM h ANTI JOIN r USING (workspace_id, run_id) UNION ALL SELECT workspace_id, run_id, 'run_without_errors_file' FROM r ANTI JOIN h USING (workspace_id, run_id)
UNION ALL SELECT workspace_id, run_id, 'failed_read_with_size' FROM (SELECT DISTINCT contribution_id, workspace_id, run_id FROM contributions WHERE read_status = 'failed' AND size_bytes IS NOT NULL)
UNION ALL SELECT workspace_id, run_id, 'contributed_without_callables' FROM (SELECT DISTINCT contribution_id, workspace_id, run_id FROM contributions WHERE contribution_state = 'contributed' AND callable_count IS NULL))
SELECT workspace_id, run_id, "check", count(*) AS rows FROM u GROUP BY ALL""")
def run_validation(spark, d):
    """Each run's tables against each other."""
    run, subject = ["workspace_id", "run_id"], ["workspace_id", "run_id", "subject_key"]
    rows = table(spark, d, "contributions")
    ledger, metrics = (table(spark, d, t).select(*subject).distinct() for t in ("contributions", "language_metrics"))
    recovered = table(spark, d, "recoveries").where("recovery_id is not null").select("recovery_id", *subject).distinct()
    errors = table(spark, d, "errors")
    lines, heads, runs = errors.where("line_no > 0").select(*run, "line_no").distinct(), errors.where("line_no = 0").select(*run).distinct(), ledger.select(*run).distinct()
    without = lambda a, b, on: a.join(b, on, "left_anti")
    return P.validation({
        "metrics_without_ledger": without(metrics, ledger, subject), "ledger_without_metrics": without(ledger, metrics, subject), "recovery_without_ledger": without(recovered, ledger, subject),
        "error_line_without_header": without(lines, heads, run), "errors_without_run": without(heads, runs, run), "run_without_errors_file": without(runs, heads, run),
        "failed_read_with_size": rows.where("read_status = 'failed' and size_bytes is not null").select("contribution_id", *run).distinct(),
        "contributed_without_callables": rows.where("contribution_state = 'contributed' and callable_count is null").select("contribution_id", *run).distinct(),
    }, run)


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
