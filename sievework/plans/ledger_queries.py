"""Queries over the ledger as a whole: inputs, policies, baselines, comparisons, duplication and canonical orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import numbers as N
from sievework.functions.paths import portable_path
from sievework.operators import aggregates as A
from sievework.operators import clones as C
from sievework.operators import diff as D
from sievework.operators import inputs as I
from sievework.operators import policy as P
from sievework.plans import evidence_queries as Q
from sievework.plans.evidence_queries import _CLONES, _CONTRIBUTION_RUNS, _EVIDENCE, _HOT, _OBS, _PORTABLE, _SUBJECT, SQL, _numbered, _sql_runs, _sql_steps, _steps
from sievework.plans.registry import Registry
from sievework.session import table

R = Registry()
query = R.query


def _digest(prefix: str, *parts: str) -> str:
    framed = " || ".join(f"unhex(printf('%016x', strlen(coalesce(({p})::VARCHAR, '')))) || encode(coalesce(({p})::VARCHAR, ''))" for p in parts)
    return f"'{prefix}' || sha256({framed})"


# -- the input ledger: one row a subject and run, flags and languages planted by the columns, revisions asked for in odd workspaces only

_URL = r"^(?:https?://(?:www\.)?|git@|ssh://git@)([A-Za-z0-9.-]+)[/:]([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
_INPUT = f"""raw AS (SELECT workspace_id, subject_key, run_id, run_seq, max(repository_url) AS url, max(CASE WHEN workspace_id % 2 = 1 THEN requested_sha END) AS sha, max(analyzed_sha) AS analyzed FROM contributions GROUP BY ALL),
said AS (SELECT *, CASE length(subject_key) % 4 WHEN 0 THEN ' python' WHEN 1 THEN '' WHEN 2 THEN 'GO' ELSE CASE WHEN run_seq = 5 THEN 'cobol' END END AS lang, CASE run_seq % 5 WHEN 4 THEN 'maybe' WHEN 3 THEN 'no' ELSE '' END AS flag FROM raw),
parsed AS (SELECT *, CASE WHEN regexp_matches(trim(url), '{_URL}') THEN 'https://' || lower(regexp_extract(trim(url), '{_URL}', 1)) || '/' || regexp_extract(trim(url), '{_URL}', 2) || '/' || regexp_extract(trim(url), '{_URL}', 3) END AS canonical_url,
 CASE lower(trim(lang)) WHEN 'python' THEN 'Python' WHEN 'go' THEN 'Go' END AS expected_language, nullif(lower(trim(sha)), '') AS requested_sha, CASE flag WHEN '' THEN true WHEN 'no' THEN false END AS enabled FROM said),
checked AS (SELECT *, concat_ws(',', CASE WHEN coalesce(trim(url), '') = '' THEN 'missing_url' WHEN canonical_url IS NULL THEN 'wrong_url' END, CASE WHEN coalesce(trim(lang), '') <> '' AND expected_language IS NULL THEN 'unknown_language' END,
 CASE WHEN NOT regexp_matches(requested_sha, '^[0-9a-f]{{7,40}}$') THEN 'wrong_sha' END, CASE WHEN flag = 'maybe' THEN 'wrong_flag' END) AS problems FROM parsed),
ledger AS (SELECT *, n > 1 AND lo <> hi AS conflict, CASE WHEN n = 1 THEN 'unique' WHEN place = 1 THEN 'representative' ELSE 'identical' END AS duplicate, CASE WHEN place > 1 THEN first END AS representative_row FROM (
 SELECT *, row_number() OVER (w ORDER BY run_seq, subject_key) AS place, count(*) OVER w AS n, min(run_seq) OVER w AS first, min(s) OVER w AS lo, max(s) OVER w AS hi FROM (SELECT *, coalesce(requested_sha, '-') || '|' || coalesce(expected_language, '-') AS s FROM checked WHERE problems = '') WINDOW w AS (PARTITION BY workspace_id, lower(canonical_url)))),
disposed AS (SELECT *, CASE WHEN conflict THEN 'refused_conflict' WHEN duplicate = 'identical' THEN 'skipped_duplicate' WHEN NOT enabled THEN 'skipped_disabled' ELSE 'pending' END AS disposition FROM ledger)
"""
_INPUT_KEY = ["workspace_id", "subject_key", "run_id", "run_seq"]


def _input_rows(spark, d) -> DataFrame:
    rows = table(spark, d, "contributions").groupBy(*_INPUT_KEY).agg(F.max("repository_url").alias("url"), F.max("requested_sha").alias("sha"), F.max("analyzed_sha").alias("analyzed"))
    rows = rows.withColumn("sha", F.when(F.col("workspace_id") % 2 == 1, F.col("sha")))
    size = F.length("subject_key") % 4
    lang = F.when(size == 0, " python").when(size == 1, "").when(size == 2, "GO").otherwise(F.when(F.col("run_seq") == 5, "cobol"))
    flag = F.when(F.col("run_seq") % 5 == 4, "maybe").when(F.col("run_seq") % 5 == 3, "no").otherwise("")
    return I.parse_rows(rows.withColumns({"lang": lang, "flag": flag}), url="url", language="lang", sha="sha", enabled="flag")


def _input_ledger(spark, d) -> DataFrame:
    return I.ledger(_input_rows(spark, d), ["workspace_id"], ["run_seq", "subject_key"], ["requested_sha", "expected_language"])


@query(f"WITH {_INPUT} SELECT workspace_id, subject_key, run_id, canonical_url, expected_language, requested_sha, enabled, problems FROM checked")
def input_rows(spark, d):
    return _input_rows(spark, d).select("workspace_id", "subject_key", "run_id", "canonical_url", "expected_language", "requested_sha", "enabled", F.array_join("problems", ",").alias("problems"))


@query(f"WITH {_INPUT} SELECT workspace_id, subject_key, run_id, canonical_url, duplicate, representative_row, conflict, disposition FROM disposed")
def input_ledger(spark, d):
    return _input_ledger(spark, d).select("workspace_id", "subject_key", "run_id", "canonical_url", "duplicate", "representative_row", "conflict", "disposition")


_OUTCOMES = f"""WITH {_INPUT}, outcome AS (SELECT workspace_id, canonical_url, CASE WHEN workspace_id % 6 <> 0 THEN max(analyzed) END AS analyzed_sha, CASE WHEN workspace_id % 2 = 0 THEN 'verified' ELSE 'unverified' END AS verification,
 CASE WHEN workspace_id % 3 = 0 THEN 'failed' ELSE 'complete' END AS status FROM checked WHERE canonical_url IS NOT NULL GROUP BY workspace_id, canonical_url),
done AS (SELECT d.* EXCLUDE (disposition), o.analyzed_sha, o.verification, CASE WHEN disposition = 'pending' AND status IS NOT NULL THEN CASE WHEN status = 'failed' AND analyzed_sha IS NULL THEN 'failed_acquisition' ELSE 'executed' END ELSE disposition END AS disposition FROM disposed d LEFT JOIN outcome o USING (workspace_id, canonical_url))
"""


def _done(spark, d) -> DataFrame:
    rows = _input_rows(spark, d).where("canonical_url is not null").groupBy("workspace_id", "canonical_url").agg(F.max("analyzed").alias("analyzed"))
    w = F.col("workspace_id")
    outcomes = rows.select(
        "workspace_id", "canonical_url", F.when(w % 6 != 0, F.col("analyzed")).alias("analyzed_sha"), F.lit(None).cast("string").alias("resolved_sha"),
        F.when(w % 2 == 0, "verified").otherwise("unverified").alias("verification"), F.when(w % 3 == 0, "failed").otherwise("complete").alias("status"),
    )
    return I.apply_outcomes(_input_ledger(spark, d), outcomes, ["workspace_id"])


@query(_OUTCOMES + "SELECT workspace_id, subject_key, run_id, disposition, CASE WHEN disposition IN ('executed', 'failed_acquisition') THEN analyzed_sha END AS analyzed_sha, disposition = 'executed' AS measured FROM done")
def input_outcomes(spark, d):
    return _done(spark, d).select("workspace_id", "subject_key", "run_id", "disposition", "analyzed_sha", "measured")


@query(_OUTCOMES + """SELECT 'frozen' AS list, workspace_id, canonical_url, analyzed_sha AS commit_sha FROM done WHERE duplicate <> 'identical' AND analyzed_sha IS NOT NULL AND verification = 'verified' AND disposition IN ('executed', 'failed_acquisition')
UNION ALL SELECT 'retry', workspace_id, canonical_url, coalesce(analyzed_sha, requested_sha, '') FROM done WHERE enabled AND duplicate <> 'identical' AND disposition IN ('executed', 'failed_acquisition')""")
def input_lists(spark, d):
    rows = _done(spark, d)
    pick = lambda df, name: df.select(F.lit(name).alias("list"), "workspace_id", "canonical_url", "commit_sha")
    return pick(I.frozen_rows(rows), "frozen").unionByName(pick(I.retry_rows(rows), "retry"))


@query(f"""WITH f AS (SELECT DISTINCT workspace_id, sha256(run_id::VARCHAR) AS h FROM contributions), g AS (SELECT workspace_id, string_agg(h, chr(10) ORDER BY h) AS t, count(*) AS files FROM f GROUP BY ALL)
SELECT workspace_id, {_digest('sha256:', 't')} AS input_hash, files FROM g""")
def input_hash(spark, d):
    rows = table(spark, d, "contributions").select("workspace_id", F.sha2(F.col("run_id").cast("string"), 256).alias("h")).distinct()
    return I.input_hash(rows, ["workspace_id"], "h")


# -- policies

_UNIT_RULES = [
    ("python-long", "lines_of_code", "gt", 700.0, "allowed", ["python"], None, None), ("callables", "callable_count", "gte", 25.0, "not_evaluable", [], "^src/", r"_test\.go$"),
    ("go-or-java", "lines_of_code", "lte", 12.0, "allowed", ["go", "java"], None, "^pkg/"),
]
_UNIT_SQL = "(VALUES " + ", ".join(f"('{r}', '{m}', '{o}', {t}::DOUBLE, '{p}', {list(ls)}::VARCHAR[], {f'{chr(39)}{a}{chr(39)}' if a else 'NULL'}, {f'{chr(39)}{x}{chr(39)}' if x else 'NULL'})" for r, m, o, t, p, ls, a, x in _UNIT_RULES) + ") AS rules(rule_id, metric, operator, threshold, partial_data, languages, admit, refuse)"
_STATE = "CASE {0} WHEN 'complete' THEN 'complete' WHEN 'partial' THEN 'partial' WHEN 'not_applicable' THEN 'not_applicable' ELSE 'unavailable' END"


def _unit_sql(keys: str, rows: str) -> str:
    return f"""WITH l AS ({rows}), u AS (SELECT {keys}, detected_language, path, completeness, 'lines_of_code' AS metric, lines_of_code::DOUBLE AS value FROM l UNION ALL SELECT {keys}, detected_language, path, completeness, 'callable_count', callable_count::DOUBLE FROM l),
j AS (SELECT rule_id, {keys}, u.metric, value AS observed, completeness AS s, CASE WHEN completeness IS NULL THEN 'measurement_absent' WHEN completeness = 'unavailable' THEN 'measurement_unavailable' WHEN completeness = 'partial' AND partial_data = 'not_evaluable' THEN 'partial_data_refused'
 WHEN completeness <> 'not_applicable' AND value IS NULL THEN 'measurement_unavailable' END AS why, CASE operator WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold WHEN 'lte' THEN value <= threshold END AS fires
 FROM u JOIN {_UNIT_SQL} ON u.metric = rules.metric WHERE (len(languages) = 0 OR list_contains(languages, lower(detected_language))) AND (admit IS NULL OR regexp_matches(path, admit)) AND NOT coalesce(regexp_matches(path, refuse), false)),
f AS (SELECT rule_id, {keys}, metric, observed, CASE WHEN s = 'not_applicable' THEN 'not_applicable' WHEN why IS NOT NULL THEN 'not_evaluable' WHEN fires THEN 'violated' ELSE 'passed' END AS status, why FROM j)
SELECT rule_id, {keys}, metric, observed, status, CASE WHEN status = 'not_evaluable' THEN why END AS reason FROM f WHERE status <> 'passed'"""


def _unit_rules(spark) -> DataFrame:
    return spark.createDataFrame(_UNIT_RULES, "rule_id string, metric string, operator string, threshold double, partial_data string, languages array<string>, admit string, refuse string")


def _state(c: str):
    return F.when(F.col(c).isin("complete", "partial", "not_applicable"), F.col(c)).otherwise("unavailable")


@query(_unit_sql("contribution_id", f"SELECT DISTINCT contribution_id, detected_language, {_PORTABLE} AS path, lines_of_code, callable_count, {_STATE.format('nloc_status')} AS completeness FROM contributions"))
def file_findings(spark, d):
    """Rules with allow-lists of languages and patterns of paths over every row of the ledger in one pass."""
    rows = table(spark, d, "contributions").select("contribution_id", "detected_language", portable_path(F.col("relative_path")).alias("path"), "lines_of_code", "callable_count", _state("nloc_status").alias("completeness")).distinct()
    return P.unit_findings(rows, _unit_rules(spark), ["contribution_id"], ["lines_of_code", "callable_count"], language="detected_language", path="path").where("status <> 'passed'")


@query(_unit_sql("workspace_id, subject_key, run_id, detected_language", f"""SELECT workspace_id, subject_key, run_id, detected_language, subject_key AS path, sum(lines_of_code) AS lines_of_code, sum(callable_count) AS callable_count,
CASE WHEN count_if(nloc_status = 'failed') = count(*) THEN 'unavailable' WHEN count_if(nloc_status IN ('failed', 'partial')) > 0 THEN 'partial' ELSE 'complete' END AS completeness
FROM {Q._sql_ledger('workspace_id', 'subject_key', 'run_id', 'detected_language', 'nloc_status', 'lines_of_code', 'callable_count')} GROUP BY ALL""").replace("workspace_id, subject_key, run_id, detected_language, detected_language", "workspace_id, subject_key, run_id, detected_language"))
def language_findings(spark, d):
    keys = ["workspace_id", "subject_key", "run_id", "detected_language"]
    failed, bad = F.count_if(F.col("nloc_status") == "failed"), F.count_if(F.col("nloc_status").isin("failed", "partial"))
    state = F.when(failed == F.count("*"), "unavailable").when(bad > 0, "partial").otherwise("complete")
    rows = Q._ledger(spark, d, *keys, "nloc_status", "lines_of_code", "callable_count").groupBy(*keys).agg(F.sum("lines_of_code").alias("lines_of_code"), F.sum("callable_count").alias("callable_count"), state.alias("completeness"))
    return P.unit_findings(rows, _unit_rules(spark), keys, ["lines_of_code", "callable_count"], language="detected_language", path="subject_key").where("status <> 'passed'")


_RANKED = "CASE attention WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 END"


@query(_HOT + f"""SELECT 'hotspot' AS rule_id, workspace_id, subject_key, detected_language, path, 'attention' AS metric, ({_RANKED})::DOUBLE AS observed, CASE WHEN attention IS NULL THEN 'not_evaluable' WHEN attention = 'high' THEN 'violated' ELSE 'passed' END AS status,
CASE WHEN attention IS NULL THEN 'measurement_absent' END AS reason FROM h""")
def hotspot_findings(spark, d):
    keys = ["workspace_id", "subject_key", "detected_language", "path"]
    rank = F.when(F.col("attention") == "high", 3).when(F.col("attention") == "moderate", 2).when(F.col("attention") == "low", 1)
    rows = Q.attention_hotspots(spark, d).select(*keys, F.lit("attention").alias("metric"), rank.cast("double").alias("value"), F.when(F.col("attention").isNotNull(), "complete").alias("completeness"))
    return P.judge(rows, spark.createDataFrame([("hotspot", "attention", "gte", 3.0, "allowed")], "rule_id string, metric string, operator string, threshold double, partial_data string"), keys)


@query(_CLONES.replace("NAMESPACE_LENGTH", str(len(C.NAMESPACE))) + "SELECT 'copies' AS rule_id, language, fingerprint, 'occurrences' AS metric, occurrences::DOUBLE AS observed, CASE WHEN occurrences > 2 THEN 'violated' ELSE 'passed' END AS status, NULL::VARCHAR AS reason FROM g")
def clone_findings(spark, d):
    rows = Q.clone_groups_lexical(spark, d).select("language", "fingerprint", F.lit("occurrences").alias("metric"), F.col("occurrences").cast("double").alias("value"), F.lit("complete").alias("completeness"))
    return P.judge(rows, spark.createDataFrame([("copies", "occurrences", "gt", 2.0, "allowed")], "rule_id string, metric string, operator string, threshold double, partial_data string"), ["language", "fingerprint"])


_INTEGRITY = {
    "metric_unavailable": "contribution_state = 'contributed' AND lines_of_code IS NULL", "measurement_incomplete": "parse_status IN ('failed', 'partial')", "unknown_category": "parse_status NOT IN ('complete', 'partial', 'failed', 'recovered', 'not_applicable')",
    "read_failure": "read_status = 'failed'", "lines_inconsistent": "nonblank_lines + blank_lines <> total_physical_lines", "code_inconsistent": "code_lines + comment_lines <> nonblank_lines", "negative_count": "least(lines_of_code, callable_count, classes, interfaces) < 0",
    "contribution_mismatch": "source_files_contribution = 0 AND contribution_state = 'contributed'", "entity_mismatch": "methods_functions <> module_functions + class_methods", "unknown_language": "detected_language IS NULL",
    "size_missing": "size_bytes IS NULL", "late_arrival": "ingested_at < recorded_at", "revision_missing": "repository_url IS NOT NULL AND analyzed_sha IS NULL",
}


@query("WITH r AS (SELECT DISTINCT * FROM contributions), c AS (SELECT workspace_id, run_id, " + ", ".join(f"count_if({c})::BIGINT AS {r}" for r, c in _INTEGRITY.items()) + " FROM r GROUP BY ALL), u AS (" + " UNION ALL ".join(f"SELECT workspace_id, run_id, '{r}' AS rule_id, {r} AS rows FROM c" for r in _INTEGRITY) + ") SELECT *, CASE WHEN rows > 0 THEN 'violated' ELSE 'passed' END AS status FROM u")
def integrity_findings(spark, d):
    """Thirteen rules about each run."""
    rows = table(spark, d, "contributions").distinct()
    return P.integrity(rows, ["workspace_id", "run_id"], {r: F.expr(c) for r, c in _INTEGRITY.items()})


_SEVERITY = {"long-subject": "violation", "no-code": "warning", "many-callables": "violation", "few-files": "info"}
_SEVERITY_SQL = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, s in _SEVERITY.items()) + " END"
_LISTED = f"""WITH {_OBS}, g AS (SELECT *, {_SEVERITY_SQL} AS severity FROM f), i AS (SELECT *, {_digest('finding:', 'rule_id', 'workspace_id', 'subject_key', 'run_id', 'metric')} AS finding_id FROM g)
"""


def _listed(spark, d) -> DataFrame:
    severity = F.coalesce(*[F.when(F.col("rule_id") == r, s) for r, s in _SEVERITY.items()])
    keys = ["rule_id", "workspace_id", "subject_key", "run_id", "metric"]
    return Q._findings(spark, d).withColumns({"severity": severity, "finding_id": P.finding_id(*[F.col(k) for k in keys])})


@query(_LISTED + """SELECT workspace_id, finding_id, severity, status, severity = 'violation' AND status IN ('violated', 'not_evaluable') AS fails,
row_number() OVER (PARTITION BY workspace_id ORDER BY CASE severity WHEN 'violation' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, rule_id, subject_key, run_id, finding_id) AS place FROM i""")
def finding_list(spark, d):
    """Findings with their identity, canonical order and whether they fail the run."""
    rows = _listed(spark, d)
    rows = A.ordered(rows, ["workspace_id"], P.finding_order("severity", "rule_id", "subject_key", "run_id", "finding_id"), "place")
    return rows.select("workspace_id", "finding_id", "severity", "status", P.requires_failure(F.col("severity"), F.col("status"), True).alias("fails"), "place")


@query(_LISTED + """SELECT workspace_id, run_id, count(*) AS findings, count_if(status = 'violated')::BIGINT AS violated, count_if(status = 'not_evaluable')::BIGINT AS not_evaluable, count_if(severity = 'violation' AND status = 'violated')::BIGINT AS failing,
CASE WHEN count_if(severity = 'violation' AND status = 'violated') > 0 THEN 1 ELSE 0 END AS exit_code FROM i GROUP BY ALL""")
def policy_totals(spark, d):
    fails = P.requires_failure(F.col("severity"), F.col("status"), False)
    counts = [F.count("*").alias("findings"), *[F.count_if(F.col("status") == s).alias(s) for s in ("violated", "not_evaluable")], F.count_if(fails).alias("failing"), F.when(F.count_if(fails) > 0, 1).otherwise(0).alias("exit_code")]
    return _listed(spark, d).groupBy("workspace_id", "run_id").agg(*counts)


@query("""WITH r AS (SELECT o_custkey % 3 AS k, 'rule-' || (o_custkey % 3) AS rule_id, o_custkey AS c_custkey FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
SELECT DISTINCT rule_id, c_custkey FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM s)""")
def unknown_subjects(spark, d):
    """Customers that rules (made from orders) name and that the run (six sevenths of the customers) doesn't have."""
    rules = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("rule-"), F.col("o_custkey") % 3).alias("rule_id"), F.array("o_custkey").alias("subjects"))
    return P.unknown_subjects(rules, table(spark, d, "customer").where("c_custkey % 7 <> 0"), "c_custkey").distinct()


_BASE = f"WITH {_OBS.split('j AS (')[0].rstrip().rstrip(',')}"


@query(_BASE + f""", c AS (SELECT *, CASE WHEN value = round(value) THEN value::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.6f', value), '0'), '.') END AS spelled FROM u WHERE completeness = 'complete' AND value IS NOT NULL)
SELECT workspace_id, subject_key, run_id, metric, value, {_digest('sha256:', 'workspace_id', 'subject_key', 'run_id', 'metric', 'spelled')} AS coordinate FROM c""")
def ratchet_capture(spark, d):
    keys = ["workspace_id", "subject_key", "run_id"]
    failed, bad = F.count_if(F.col("nloc_status") == "failed"), F.count_if(F.col("nloc_status").isin("failed", "partial"))
    state = F.when(failed == F.count("*"), "unavailable").when(bad > 0, "partial").otherwise("complete")
    rows = Q._ledger(spark, d, *keys, "nloc_status", "lines_of_code", "callable_count")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("lines_of_code").alias("lines_of_code"), F.sum("callable_count").alias("callable_count"), state.alias("state"))
    both = P.observations(sums, keys, {"lines_of_code": F.col("lines_of_code"), "callable_count": F.col("callable_count")}, F.col("state"))
    return P.capture(both.unionByName(P.observations(sums, keys, {"files": F.col("files")}, F.lit("complete"))), keys)


@query(f"""WITH {_sql_runs('language_metrics', 'workspace_id')}, v AS (SELECT workspace_id, subject_key, run_id, max(metric_contract_version) AS contract, max(artifact_schema_version) AS schema_ FROM language_metrics GROUP BY ALL),
n AS (SELECT v.*, k, next_run FROM v JOIN runs USING (workspace_id, run_id)), a AS (SELECT * EXCLUDE (run_id), next_run AS run_id FROM n WHERE next_run IS NOT NULL), b AS (SELECT * FROM n WHERE k > 1)
SELECT workspace_id, subject_key, run_id, CASE WHEN a.k IS NULL THEN 'no_baseline' WHEN b.k IS NULL THEN 'no_current' WHEN a.contract IS DISTINCT FROM b.contract OR a.schema_ IS DISTINCT FROM b.schema_
THEN 'incompatible:' || concat_ws(',', CASE WHEN a.contract IS DISTINCT FROM b.contract THEN 'contract' END, CASE WHEN a.schema_ IS DISTINCT FROM b.schema_ THEN 'schema_' END) ELSE 'admitted' END AS decision FROM a FULL JOIN b USING (workspace_id, subject_key, run_id)""")
def ratchet_admission(spark, d):
    """Whether each subject's previous run may serve as a baseline: exact pairing, equal contracts."""
    rows = table(spark, d, "language_metrics").groupBy("workspace_id", "subject_key", "run_id").agg(F.max("metric_contract_version").alias("contract"), F.max("artifact_schema_version").alias("schema_"))
    left, right = D.sides(D.with_runs(rows, _numbered(spark, d, "language_metrics", ["workspace_id"]), ["workspace_id"], "run_id"), "run_id")
    return P.admission(left, right, ["workspace_id", "subject_key", "run_id"], ["contract", "schema_"])


# -- comparisons

_WATCHED = ("digest", "callable_count", "lines_of_code", "classes_structs")


@query(_sql_steps(*_WATCHED) + _EVIDENCE.format(", ".join(f"l_{c}, r_{c}" for c in _WATCHED[1:])) + ", u AS (" + " UNION ALL ".join(f"SELECT workspace_id, subject_key, run_id, path, state, '{c}' AS dimension, l_{c}::DOUBLE AS before, r_{c}::DOUBLE AS after FROM e" for c in _WATCHED[1:]) + """)
SELECT *, after - before AS delta, CASE WHEN state IN ('added', 'removed') THEN 'side_absent' WHEN before IS NULL OR after IS NULL THEN 'measurement_unavailable' END AS reason FROM u WHERE before IS DISTINCT FROM after""")
def complexity_file_deltas(spark, d):
    rows = D.step_evidence(_steps(spark, d, *_WATCHED), "digest")
    return D.row_deltas(rows, [*_SUBJECT, "run_id", "path"], list(_WATCHED[1:]), "state")


_MEASURED = {"measured": "count(callable_count)", "total": "sum(callable_count)", "most": "max(callable_count)"}


@query(f"""WITH {_CONTRIBUTION_RUNS}, g AS (SELECT workspace_id, subject_key, detected_language, run_id, {', '.join(f'({c})::DOUBLE AS {n}' for n, c in _MEASURED.items())} FROM {Q._sql_ledger('workspace_id', 'subject_key', 'detected_language', 'run_id', 'callable_count')} GROUP BY ALL),
n AS (SELECT g.*, k, next_run FROM g JOIN runs USING (workspace_id, subject_key, run_id)), a AS (SELECT * EXCLUDE (run_id), next_run AS run_id FROM n WHERE next_run IS NOT NULL), b AS (SELECT * FROM n WHERE k > 1),
j AS (SELECT workspace_id, subject_key, run_id, detected_language, a.k IS NULL OR b.k IS NULL AS absent, {', '.join(f'a.{n} AS l_{n}, b.{n} AS r_{n}' for n in _MEASURED)} FROM a FULL JOIN b USING (workspace_id, subject_key, run_id, detected_language)),
u AS ({' UNION ALL '.join(f"SELECT workspace_id, subject_key, run_id, detected_language, '{n}' AS dimension, l_{n} AS before, r_{n} AS after, absent FROM j" for n in _MEASURED)})
SELECT workspace_id, subject_key, run_id, detected_language, dimension, before, after, after - before AS delta, CASE WHEN absent THEN 'side_absent' WHEN before IS NULL OR after IS NULL THEN 'measurement_unavailable' END AS reason FROM u WHERE after - before IS NULL OR after <> before""")
def complexity_language_deltas(spark, d):
    keys = [*_SUBJECT, "detected_language"]
    rows = Q._ledger(spark, d, *keys, "run_id", "callable_count").groupBy(*keys, "run_id").agg(F.count("callable_count").alias("measured"), F.sum("callable_count").alias("total"), F.max("callable_count").alias("most"))
    left, right = D.sides(D.with_runs(rows, _numbered(spark, d, "contributions", _SUBJECT), _SUBJECT, "run_id"), "run_id")
    return D.deltas(left, right, [*_SUBJECT, "run_id", "detected_language"], list(_MEASURED))


@query(f"""WITH {_CONTRIBUTION_RUNS}, g AS (SELECT workspace_id, subject_key, run_id, max(analyzed_sha) AS sha, max(repository_url) AS url, max(requested_sha) AS asked FROM contributions GROUP BY ALL), n AS (SELECT g.*, k FROM g JOIN runs USING (workspace_id, subject_key, run_id))
SELECT b.workspace_id, b.subject_key, b.run_id, a.sha AS before, b.sha AS after, CASE WHEN a.sha IS NULL OR b.sha IS NULL THEN 'unknown' WHEN a.sha = b.sha THEN 'same' ELSE 'changed' END AS source,
concat_ws(',', CASE WHEN a.url IS DISTINCT FROM b.url THEN 'url' END, CASE WHEN a.asked IS DISTINCT FROM b.asked THEN 'asked' END) AS differences FROM n a JOIN n b ON a.workspace_id = b.workspace_id AND a.subject_key = b.subject_key AND a.k + 1 = b.k""")
def source_identity(spark, d):
    rows = table(spark, d, "contributions").groupBy(*_SUBJECT, "run_id").agg(F.max("analyzed_sha").alias("sha"), F.max("repository_url").alias("url"), F.max("requested_sha").alias("asked"))
    left, right = D.sides(D.with_runs(rows, _numbered(spark, d, "contributions", _SUBJECT), _SUBJECT, "run_id"), "run_id")
    return D.identity_changes(left, right, [*_SUBJECT, "run_id"], "sha", ["url", "asked"])


_CHANGES = _sql_steps("digest") + _EVIDENCE.format("1") + """, c AS (SELECT workspace_id, subject_key, run_id, CASE WHEN state <> 'added' THEN path END AS old_path, CASE WHEN state <> 'removed' THEN path END AS new_path, state FROM e WHERE state IN ('added', 'removed', 'changed'))
"""


@query(_CHANGES + f"""SELECT workspace_id, subject_key, run_id, old_path, new_path, state, {_digest('change:', 'workspace_id', 'subject_key', 'run_id', 'old_path', 'new_path', 'state')} AS change_id,
row_number() OVER (PARTITION BY workspace_id, subject_key, run_id ORDER BY old_path NULLS LAST, new_path NULLS LAST, state) AS place FROM c""")
def change_list(spark, d):
    rows = Q.snapshot_diff(spark, d).where("state in ('added', 'removed', 'changed')")
    rows = rows.select(*_SUBJECT, "run_id", F.when(F.col("state") != "added", F.col("path")).alias("old_path"), F.when(F.col("state") != "removed", F.col("path")).alias("new_path"), "state")
    return D.change_ids(rows, [*_SUBJECT, "run_id"], "old_path", "new_path", "state")


_STATES = ("added", "removed", "changed", "unchanged", "indeterminate")


@query(_sql_steps("digest") + _EVIDENCE.format("1") + f"SELECT workspace_id, run_id, count(DISTINCT subject_key) AS subjects, {', '.join(f'count_if(state = {s!r})::BIGINT AS {s}' for s in _STATES)}, CASE WHEN count_if(state IN ('added', 'removed', 'changed')) > 0 THEN 'changed' WHEN count_if(state = 'indeterminate') > 0 THEN 'not_evaluable' ELSE 'unchanged' END AS verdict FROM e GROUP BY ALL")
def run_comparison(spark, d):
    """Each run against the one before, explained by counts."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    verdict = F.when(n("added", "removed", "changed") > 0, "changed").when(n("indeterminate") > 0, "not_evaluable").otherwise("unchanged")
    return Q.snapshot_diff(spark, d).groupBy("workspace_id", "run_id").agg(F.countDistinct("subject_key").alias("subjects"), *[n(s).alias(s) for s in _STATES], verdict.alias("verdict"))


# -- duplication

_LINES_SQL = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


@query(f"""WITH t AS (SELECT doc_id, len(list_filter({_LINES_SQL}, lambda l: trim(l, ' ') <> '')) AS nloc, length(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS tokens, length(regexp_extract_all(text, '[.;]')) AS statements FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, concat_ws(',', CASE WHEN statements < 4 THEN 'statements' END, CASE WHEN tokens < 40 THEN 'tokens' END, CASE WHEN nloc < 8 THEN 'nloc' END) AS missed FROM t) SELECT doc_id, missed, missed = '' AS admitted FROM m""")
def body_floors(spark, d):
    from sievework.functions.text import lines

    rows = table(spark, d, "documents").where("text is not null")
    nloc = F.size(F.filter(lines(F.col("text")), lambda x: F.trim(x) != ""))
    return C.body_floors(rows, F.regexp_count("text", F.lit("[.;]")), F.regexp_count("text", F.lit("[A-Za-z0-9_]+")), nloc).select("doc_id", "missed", "admitted")


@query(_CLONES.replace("NAMESPACE_LENGTH", str(len(C.NAMESPACE))) + f""", m AS (SELECT DISTINCT fingerprint, {_digest('', 'doc_id')} AS h FROM f WHERE fingerprint IN (SELECT fingerprint FROM g)),
i AS (SELECT fingerprint, h[1:2] AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM m GROUP BY ALL), k AS (SELECT fingerprint, 'dg1:' || sha256(string_agg(h, '' ORDER BY b)) AS group_id, sum(n)::BIGINT AS occurrences FROM i GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY occurrences DESC, group_id) AS place FROM k""")
def clone_group_ids(spark, d):
    docs = Q._docs(spark, d)
    content = C.canonical_text(F.col("text"))
    members = C.occurrence_ids(docs, C.group_clones(docs, "lang", "path", content), "lang", ["doc_id"], content)
    return C.group_order(C.group_ids(members, ["fingerprint"], ["doc_id"]), [])


@query("""WITH r AS (SELECT DISTINCT contribution_id, workspace_id, run_id, loc_status, structural_complexity_status FROM contributions),
u AS (SELECT workspace_id, run_id, 'lexical' AS kind, loc_status AS s FROM r UNION ALL SELECT workspace_id, run_id, 'structural', structural_complexity_status FROM r), v AS (SELECT workspace_id, run_id, kind, CASE WHEN s = 'not_applicable' THEN 'not_requested' ELSE s END AS s FROM u)
SELECT workspace_id, run_id, kind, CASE WHEN count_if(s <> 'not_requested') = 0 THEN 'not_requested' WHEN count_if(s = 'failed') = count_if(s <> 'not_requested') THEN 'failed' WHEN count_if(s IN ('failed', 'partial')) > 0 THEN 'partial' ELSE 'complete' END AS status,
count_if(s <> 'not_requested')::BIGINT AS requested, count_if(s = 'failed')::BIGINT AS failed FROM v GROUP BY ALL""")
def duplication_status(spark, d):
    rows = Q._ledger(spark, d, "workspace_id", "run_id", "loc_status", "structural_complexity_status")
    kinds = F.array(F.struct(F.lit("lexical").alias("kind"), F.col("loc_status").alias("s")), F.struct(F.lit("structural").alias("kind"), F.col("structural_complexity_status").alias("s")))
    long = rows.select("workspace_id", "run_id", F.explode(kinds).alias("x")).select("workspace_id", "run_id", "x.kind", F.when(F.col("x.s") == "not_applicable", "not_requested").otherwise(F.col("x.s")).alias("s"))
    return C.kind_status(long, ["workspace_id", "run_id", "kind"], "s")


# -- orders, rendering, outcomes

_ORDER = "CASE attention WHEN 'high' THEN 1 WHEN 'moderate' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query(_HOT + f"SELECT workspace_id, subject_key, path, detected_language, attention, row_number() OVER (PARTITION BY workspace_id ORDER BY {_ORDER}, complexity DESC NULLS LAST, churn DESC NULLS LAST, subject_key, path, detected_language NULLS FIRST) AS place FROM h")
def hotspot_order(spark, d):
    rank = F.when(F.col("attention") == "high", 1).when(F.col("attention") == "moderate", 2).when(F.col("attention") == "low", 3).otherwise(4)
    rows = A.ordered(Q.attention_hotspots(spark, d), ["workspace_id"], [rank, F.col("complexity").desc_nulls_last(), F.col("churn").desc_nulls_last(), F.col("subject_key"), F.col("path"), F.col("detected_language").asc_nulls_first()], "place")
    return rows.select("workspace_id", "subject_key", "path", "detected_language", "attention", "place")


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS cell FROM part)
SELECT p_partkey, coalesce(CASE WHEN price = round(price) THEN price::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.6f', price), '0'), '.') END, 'unavailable') AS shown, CASE WHEN cell IS NULL THEN 'null' ELSE '"' || cell || '"' END AS cell FROM v""")
def rendered_values(spark, d):
    """Numbers in one spelling, what wasn't measured as such, and NULL apart from the empty text."""
    k = F.col("p_partkey")
    cell = F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", N.rendered(F.when(k % 7 != 0, F.col("p_retailprice"))).alias("shown"), N.evidence_cell(cell).alias("cell"))


@query(f"WITH q AS ({SQL['ledger_reconcile']}) SELECT workspace_id, run_id, dimension, outcome, count(*) AS n FROM q GROUP BY ALL")
def reconciliation_counts(spark, d):
    return Q.ledger_reconcile(spark, d).groupBy("workspace_id", "run_id", "dimension", "outcome").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT contribution_id, workspace_id, run_id, total_physical_lines AS t, blank_lines AS b, nonblank_lines AS n, code_lines AS c, comment_lines AS m FROM contributions),
s AS (SELECT workspace_id, run_id, CASE WHEN t + b + n + c + m IS NULL THEN 'not_evaluable' WHEN t = b + n AND n = c + m THEN 'consistent' ELSE 'inconsistent' END AS state FROM r) SELECT workspace_id, run_id, state, count(*) AS n FROM s GROUP BY ALL""")
def composition_states(spark, d):
    rows = Q._ledger(spark, d, "workspace_id", "run_id", "total_physical_lines", "blank_lines", "nonblank_lines", "code_lines", "comment_lines")
    c = F.col
    holds = (c("total_physical_lines") == c("blank_lines") + c("nonblank_lines")) & (c("nonblank_lines") == c("code_lines") + c("comment_lines"))
    known = (c("total_physical_lines") + c("blank_lines") + c("nonblank_lines") + c("code_lines") + c("comment_lines")).isNotNull()
    return rows.groupBy("workspace_id", "run_id", F.when(~known, "not_evaluable").when(holds, "consistent").otherwise("inconsistent").alias("state")).agg(F.count("*").alias("n"))


@query(f"""WITH q AS ({SQL['status_rollup']}), s AS (SELECT workspace_id, run_id, metric_status FROM q)
SELECT workspace_id, run_id, count(*) AS subjects, count_if(metric_status = 'complete')::BIGINT AS complete, count_if(metric_status = 'failed')::BIGINT AS failed,
CASE WHEN count_if(metric_status = 'failed') = count(*) THEN 'failed' WHEN count_if(metric_status IN ('failed', 'partial')) > 0 THEN 'partial' ELSE 'complete' END AS outcome FROM s GROUP BY ALL""")
def measurement_outcome(spark, d):
    n = lambda *s: F.count_if(F.col("metric_status").isin(*s))
    outcome = F.when(n("failed") == F.count("*"), "failed").when(n("failed", "partial") > 0, "partial").otherwise("complete")
    return Q.status_rollup(spark, d).groupBy("workspace_id", "run_id").agg(F.count("*").alias("subjects"), n("complete").alias("complete"), n("failed").alias("failed"), outcome.alias("outcome"))


@query("""WITH p AS (SELECT event_type, user_id % 2 AS side, count(value) AS n, median(value) AS m FROM events GROUP BY ALL), j AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb FROM (SELECT * FROM p WHERE side = 0) a FULL JOIN (SELECT * FROM p WHERE side = 1) b USING (event_type))
SELECT event_type, round(ma, 6) AS before, round(mb, 6) AS after, CASE WHEN na IS NULL OR nb IS NULL THEN 'side_absent' WHEN least(na, nb) < 5 THEN 'insufficient_samples' ELSE 'comparable' END AS comparability,
CASE WHEN least(na, nb) >= 5 THEN round(mb - ma, 6) END AS delta, CASE WHEN least(na, nb) >= 5 THEN abs(round(mb - ma, 6)) <= 0.05 END AS within_noise FROM j""")
def performance_comparison(spark, d):
    rows = table(spark, d, "events").withColumn("side", F.col("user_id") % 2)
    sides = [rows.where(F.col("side") == s).groupBy("event_type").agg(F.count("value").alias("samples"), F.median("value").alias("median")) for s in (0, 1)]
    return A.compare_profiles(*sides, ["event_type"], least=5, noise=0.05)


_WARN = {"no_code_in_source": "files > 0 AND coalesce(code, 0) = 0", "callables_without_code": "coalesce(code, 0) = 0 AND calls > 0", "many_failed": "failed * 2 > files", "single_file": "files = 1"}


@query(f"""WITH g AS (SELECT workspace_id, subject_key, run_id, count(*) AS files, sum(lines_of_code) AS code, sum(callable_count) AS calls, count_if(parse_status = 'failed') AS failed FROM {Q._sql_ledger('workspace_id', 'subject_key', 'run_id', 'lines_of_code', 'callable_count', 'parse_status')} GROUP BY ALL)
SELECT workspace_id, subject_key, run_id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{w}' END" for w, c in _WARN.items())}) AS warnings, CASE WHEN failed = files THEN 'unreadable' WHEN coalesce(code, 0) = 0 THEN 'empty' WHEN failed > 0 THEN 'degraded' ELSE 'sound' END AS explanation FROM g""")
def metric_warnings(spark, d):
    """Suspicious totals, all reasons that hold; and the first explanation of a fixed order that fits a subject."""
    rows = Q._ledger(spark, d, *_SUBJECT, "run_id", "lines_of_code", "callable_count", "parse_status").groupBy(*_SUBJECT, "run_id")
    sums = rows.agg(F.count("*").alias("files"), F.sum("lines_of_code").alias("code"), F.sum("callable_count").alias("calls"), F.count_if(F.col("parse_status") == "failed").alias("failed"))
    why = F.when(F.expr("failed = files"), "unreadable").when(F.expr("coalesce(code, 0) = 0"), "empty").when(F.expr("failed > 0"), "degraded").otherwise("sound")
    return sums.select(*_SUBJECT, "run_id", A.reasons({w: F.expr(c) for w, c in _WARN.items()}).alias("warnings"), why.alias("explanation"))


@query("""WITH m AS (SELECT DISTINCT workspace_id, subject_key, run_id, detected_language FROM language_metrics), c AS (SELECT DISTINCT workspace_id, subject_key, run_id, detected_language FROM contributions WHERE source_files_contribution = 1),
j AS (SELECT coalesce(m.workspace_id, c.workspace_id) AS workspace_id, coalesce(m.run_id, c.run_id) AS run_id, m.run_id IS NULL AS no_m, c.run_id IS NULL AS no_c FROM m FULL JOIN c USING (workspace_id, subject_key, run_id, detected_language))
SELECT workspace_id, run_id, CASE WHEN no_m THEN 'without_projection' WHEN no_c THEN 'without_ledger' ELSE 'both' END AS state, count(*) AS n FROM j GROUP BY ALL""")
def projection_consistency(spark, d):
    """Whether the ledger and its projection by language know the same coordinates."""
    keys = ["workspace_id", "subject_key", "run_id", "detected_language"]
    a = table(spark, d, "language_metrics").select(*keys).distinct().withColumn("m", F.lit(True))
    b = table(spark, d, "contributions").where("source_files_contribution = 1").select(*keys).distinct().withColumn("c", F.lit(True))
    state = F.when(F.col("m").isNull(), "without_projection").when(F.col("c").isNull(), "without_ledger").otherwise("both")
    return a.join(b, keys, "full").groupBy("workspace_id", "run_id", state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT workspace_id, ltrim(lower(content_sha256), '0') AS h FROM source_files WHERE content_sha256 IS NOT NULL), c AS (SELECT DISTINCT contribution_id, workspace_id, run_id, ltrim(lower(regexp_extract(trim(content_sha256), '([0-9a-fA-F]+)$', 1)), '0') AS h FROM contributions WHERE content_sha256 IS NOT NULL)
SELECT contribution_id, workspace_id, run_id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.workspace_id = c.workspace_id AND s.h = c.h)""")
def ledger_orphans(spark, d):
    """Ledger rows whose content no text of their workspace has."""
    from sievework.functions.paths import hex_number

    texts = table(spark, d, "source_files").select("workspace_id", hex_number(F.col("content_sha256")).alias("h")).where("h is not null").distinct()
    rows = table(spark, d, "contributions").where("content_sha256 is not null").select("contribution_id", "workspace_id", "run_id", hex_number(F.col("content_sha256")).alias("h")).distinct()
    return rows.join(texts, ["workspace_id", "h"], "left_anti").select("contribution_id", "workspace_id", "run_id")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
