"""Queries over listings, documents and reports, with their SQL; listings are made from the columns of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import binding as B
from sievework.operators import callables as L
from sievework.plans import evidence_queries as Q
from sievework.plans.evidence_queries import _SPANS, _spans
from sievework.plans.ledger_queries import R as LEDGER
from sievework.plans.ledger_queries import change_list, run_comparison
from sievework.plans.registry import Registry
from sievework.plans.source_queries import _DEEP, _FILE, _LANGS, _by_k, _list, _metrics, _part, _planted_callable
from sievework.sources import reports as W
from sievework.sources import strict_json as J
from sievework.sources import versions as V
from sievework.session import table

R = Registry()
query = R.query
_K = "(p_partkey % 12)"


def _lines(spark, d, *cases: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", _by_k(F.col("k"), [F.format_string(c, F.col("p_partkey")) if "%" in c else c for c in cases]).alias("text"))


_MODES = f"""CASE WHEN {_K} < 4 THEN [{{'m': '100644', 'k': 'regular', 'p': 'src/' || p_partkey || '.py'}}, {{'m': '120000', 'k': 'symlink', 'p': 'link'}}] WHEN {_K} < 8 THEN [{{'m': '160000', 'k': 'submodule', 'p': 'mod'}}] ELSE [] END"""


@query(f"SELECT p_partkey, x.m AS mode, x.k AS kind, repeat('a', 40) AS object, x.p AS path FROM (SELECT p_partkey, unnest({_MODES}) AS x FROM part)")
def tree_modes(spark, d):
    a = "a" * 40
    return V.tree_modes(_lines(spark, d, *[f"100644 blob {a}\t./src//%d.py\r\n120000 blob {a}\tlink\n120000 blob {a}\tlink\nnoise"] * 4, *[f"160000 commit {a}\tmod"] * 4, "", "nothing", f"100644 {a}\tx"), ["p_partkey"], "text")


@query(f"""SELECT p_partkey, change, old_path, new_path, CASE WHEN old_path IS NOT NULL THEN 'abc1' END AS old_object, CASE WHEN new_path IS NOT NULL THEN 'abc2' END AS new_object FROM (SELECT p_partkey, CASE {_K} WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'changed' WHEN 3 THEN 'renamed' WHEN 4 THEN 'copied' WHEN 5 THEN 'type_changed' END AS change,
CASE WHEN {_K} = 0 THEN NULL ELSE 'a/' || p_partkey END AS old_path, CASE {_K} WHEN 1 THEN NULL WHEN 3 THEN 'b/c' WHEN 4 THEN 'b/c' ELSE 'a/' || p_partkey END AS new_path FROM part WHERE {_K} < 6)""")
def raw_changes(spark, d):
    z = "0000"
    return V.raw_changes(_lines(spark, d, f":000000 100644 {z} abc2 A\ta/%d", f":100644 000000 abc1 {z} D\ta\\%d", ":100644 100644 abc1 abc2 M\ta/%d", ":100644 100644 abc1 abc2 R100\ta/%d\tb/./c", ":100644 100644 abc1 abc2 C75\ta/%d\tb/c", ":100644 120000 abc1 abc2 T\ta/%d", "", "x", "M\ta"), ["p_partkey"], "text")


@query(f"SELECT p_partkey, CASE {_K} WHEN 0 THEN 'untracked' WHEN 1 THEN 'modified' WHEN 2 THEN 'conflicted' WHEN 3 THEN 'ignored' WHEN 4 THEN 'modified' END AS state, 'a/' || p_partkey AS path FROM part WHERE {_K} < 5")
def worktree_states(spark, d):
    return V.worktree(_lines(spark, d, "?? a/%d", " M a/%d", "UU a/%d", "!! a/%d", 'R  old -> "a/%d"', "", "# branch"), ["p_partkey"], "text")


@query(f"SELECT p_partkey, {_K} IN (0, 3, 4) AS inside FROM part")
def contained_paths(spark, d):
    rows = _lines(spark, d, "a/%d", "../a/%d", "/a/%d", "a/../b/%d", "./a\\b/%d", "C:\\a%d", "a/../../b%d", "~/a%d", *["\\\\host\\a%d"] * 4)
    return rows.select("p_partkey", V.contained(F.col("text")).alias("inside"))


@query("WITH c AS (" + LEDGER.sql["change_list"] + "), h AS (" + Q.SQL["snapshot_diff"] + """), x AS (SELECT workspace_id, subject_key, run_id, state, path, CASE WHEN state = 'removed' THEN left_digest ELSE right_digest END AS object FROM h WHERE state IN ('added', 'removed')),
o AS (SELECT workspace_id, subject_key, run_id, object, min(path) AS old_path FROM x WHERE state = 'removed' AND object IS NOT NULL GROUP BY ALL HAVING count(*) = 1), n AS (SELECT workspace_id, subject_key, run_id, object, min(path) AS new_path FROM x WHERE state = 'added' AND object IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
SELECT * FROM o JOIN n USING (workspace_id, subject_key, run_id, object)""")
def unique_renames(spark, d):
    rows = Q.snapshot_diff(spark, d).where("state in ('added', 'removed')")
    rows = rows.select("workspace_id", "subject_key", "run_id", F.col("state").alias("change"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.col("left_digest").alias("old_object"), F.col("right_digest").alias("new_object"))
    return V.unique_renames(rows, ["workspace_id", "subject_key", "run_id"])


@query(f"SELECT p_partkey, CASE {_K} WHEN 0 THEN NULL WHEN 1 THEN 'repeated_key:a' WHEN 2 THEN 'too_deep' WHEN 3 THEN 'too_many_items' WHEN 4 THEN 'not_finite:NaN' WHEN 5 THEN 'malformed' WHEN 6 THEN 'missing' WHEN 7 THEN 'too_many_bytes' WHEN 8 THEN 'not_finite:number' ELSE 'malformed' END AS fault FROM part")
def strict_json(spark, d):
    cases = ['{"a": %d, "b": [1.5, null]}', '{"a": 1, "a": %d}', "[" * 9 + "%d" + "]" * 9, "[" + "%1$d," * 40 + "1]", '{"a": NaN}', '{"a": %d', None, '"' + "x" * 300 + '"', "[1e999]"]
    text = _by_k(F.col("k"), [None if c is None else F.format_string(c, F.col("p_partkey")) if "%" in c else c for c in [*cases, "", "", ""]])
    return J.checked(_part(spark, d).select("p_partkey", text.alias("t")), ["p_partkey"], "t", most_bytes=290, most_depth=8, most_items=30).select("p_partkey", "fault")


_DIFFERENCES = "[" + ", ".join(f"{{'p': '{p}', 'd': '{x}'}}" for p, x in (("/a", "changed"), ("/b/0", "type_changed"), ("/c~1d", "removed"), ("/e/f", "added"))) + "]"


@query(f"SELECT p_partkey, x.p AS pointer, x.d AS difference FROM (SELECT p_partkey, unnest({_DIFFERENCES}) AS x FROM part WHERE {_K} < 3) WHERE p_partkey <> 0 OR x.p <> '/a'")
def payload_differences(spark, d):
    rows = _part(spark, d).select("p_partkey", "k", F.format_string('{"a": %d, "b": [1, 2], "c/d": {}, "g": null}', F.col("p_partkey")).alias("l"))
    rows = rows.withColumn("r", F.when(F.col("k") < 3, F.format_string('{"g": null, "a": -%d, "b": ["1", 2], "e": {"f": true}}', F.col("p_partkey"))).otherwise(F.col("l")))
    side = lambda c: J.flatten(J.checked(rows, ["p_partkey"], c), ["p_partkey"])
    return J.structural_difference(side("l"), side("r"), ["p_partkey"])


_BOUND = """WITH s AS (SELECT DISTINCT workspace_id || '/' || subject_key AS subject, analyzed_sha AS revision, CASE WHEN workspace_id % 3 <> 0 THEN 'scope-' || (workspace_id % 2) END AS scope FROM contributions),
e AS (SELECT DISTINCT run_id AS ident, CASE WHEN run_id % 5 <> 0 THEN analyzed_sha ELSE NULL END AS revision, 'scope-' || (run_id % 2) AS scope, subject_key FROM contributions), v AS (SELECT ident || '/' || subject_key AS ident, max(revision) AS revision, max(scope) AS scope FROM e GROUP BY 1),
j AS (SELECT v.ident, v.revision, count(s.revision) AS n, count(DISTINCT CASE WHEN s.scope = v.scope THEN s.subject END) AS fit, min(CASE WHEN s.scope = v.scope THEN s.subject END) AS subject FROM v LEFT JOIN s ON v.revision = s.revision GROUP BY ALL)
SELECT ident, CASE WHEN revision IS NULL THEN 'refused_no_revision' WHEN n = 0 THEN 'refused_unknown_revision' WHEN fit = 0 THEN 'refused_other_scope' WHEN fit > 1 THEN 'refused_ambiguous' ELSE 'bound' END AS decision,
CASE WHEN n > 0 AND fit = 1 THEN subject END AS subject, CASE WHEN n > 0 AND fit = 1 THEN true END AS compared FROM j"""


@query(_BOUND)
def evidence_binding(spark, d):
    rows = table(spark, d, "contributions")
    w, r = F.col("workspace_id"), F.col("run_id")
    subjects = rows.select(F.concat(w, F.lit("/"), "subject_key").alias("subject"), F.col("analyzed_sha").alias("revision"), F.when(w % 3 != 0, F.concat(F.lit("scope-"), w % 2)).alias("scope")).distinct()
    evidence = rows.groupBy(F.concat(r, F.lit("/"), "subject_key").alias("ident")).agg(F.max(F.when(r % 5 != 0, F.col("analyzed_sha"))).alias("revision"), F.max(F.concat(F.lit("scope-"), r % 2)).alias("scope"))
    return B.bind(evidence, subjects, ident="ident", subject="subject", revision="revision", scope="scope")


@query(_SPANS + """, h AS (SELECT o_custkey % 100 + 1 AS path, o_orderkey % 1000 AS h0, o_orderkey % 4 AS k FROM orders), t AS (SELECT DISTINCT path, id, s0, e0 FROM s)
SELECT path, id, count(*) AS hunks, count_if(k = 0)::BIGINT AS anchors FROM t JOIN h USING (path) WHERE CASE WHEN k = 0 THEN s0 <= h0 AND h0 <= e0 ELSE s0 <= h0 + k - 1 AND h0 <= e0 END GROUP BY ALL""")
def affected_callables(spark, d):
    hunks = table(spark, d, "orders").select((F.col("o_custkey") % 100 + 1).alias("path"), (F.col("o_orderkey") % 1000).alias("at"), (F.col("o_orderkey") % 4).alias("count"))
    return B.affected(_spans(spark, d).distinct().withColumnsRenamed({"s0": "start", "e0": "end"}), hunks, ["path"])


# -- reports

_CELLS = ("workspace_id", "run_id", "subjects", "added", "removed", "changed", "verdict")
_REPORT = "WITH c AS (" + LEDGER.sql["run_comparison"] + ") "


@query(_REPORT + "SELECT workspace_id, run_id, '| ' || concat_ws(' | ', " + ", ".join(f"replace({c}::VARCHAR, '_', '\\_')" for c in _CELLS) + ") || ' |' AS line FROM c")
def summary_markdown(spark, d):
    return W.markdown_rows(run_comparison(spark, d), list(_CELLS), ["workspace_id", "run_id"])


@query(_REPORT + "SELECT workspace_id, run_id, '<tr>' || " + " || ".join(f"'<td>' || {c}::VARCHAR || '</td>'" for c in _CELLS) + " || '</tr>' AS line FROM c")
def report_html(spark, d):
    return W.html_rows(run_comparison(spark, d), list(_CELLS), ["workspace_id", "run_id"])


@query(_REPORT + """SELECT workspace_id, run_id, '{"added":' || added || ',"changed":' || changed || ',"removed":' || removed || ',"verdict":"' || verdict || '"}' AS document FROM c""")
def report_view(spark, d):
    return W.view_json(run_comparison(spark, d), ["workspace_id", "run_id"], ["added", "removed", "changed", "verdict"])


@query(_REPORT + "SELECT workspace_id, run_id, '# ' || run_id || chr(10) || '- subjects: ' || subjects || chr(10) || '- verdict: ' || replace(verdict, '_', '\\_') AS text FROM c")
def fact_sheets(spark, d):
    return W.fact_sheet(run_comparison(spark, d), ["workspace_id", "run_id"], "run_id", ["subjects", "verdict"])


@query(_REPORT + ", k AS (" + LEDGER.sql["change_list"] + r""") SELECT workspace_id, run_id, 'runs' AS section, '| ' || replace(verdict, '_', '\_') || ' |' AS line FROM c
UNION ALL SELECT workspace_id, run_id, 'changes', '| ' || state || ' | ' || regexp_replace(coalesce(new_path, 'unavailable'), '([\\`*_{}\[\]()#+\-.!|<>])', '\\\1', 'g') || ' |' FROM k""")
def dossier(spark, d):
    keys = ["workspace_id", "run_id"]
    return W.dossier({"runs": W.markdown_rows(run_comparison(spark, d), ["verdict"], keys), "changes": W.markdown_rows(change_list(spark, d), ["state", "new_path"], keys)}, keys)


# -- bodies

def _planted(spark, d) -> DataFrame:
    n = F.col("p_size") % 4
    texts = F.array(*[F.struct(F.lit(x).alias("language"), _planted_callable(n, x).alias("text")) for x in _LANGS])
    rows = table(spark, d, "part").select("p_partkey", F.explode(texts).alias("x")).select("x.language", "p_partkey", "x.text")
    return L.file_metrics(rows, ["language", "p_partkey"], "language", "text")


@query(f"""WITH l AS (SELECT p_partkey, {_DEEP} AS n, unnest({_list(_LANGS)}) AS language FROM part)
SELECT language, n AS nested, count(*) AS occurrences, count(*) AS files FROM l GROUP BY ALL HAVING count(*) >= 2""")
def planted_body_clones(spark, d):
    """Bodies of one structure among planted callables; how deep they nest is told by their statements."""
    found = L.callables(_planted(spark, d), ["language", "p_partkey"])
    groups = L.body_groups(found, ["language", "p_partkey"], "structural")
    base = F.when(F.col("language") == "Go", 4).otherwise(3)  # statements beside the nested ones
    return groups.select("language", (F.col("statements") - base).cast("bigint").alias("nested"), "occurrences", "files")


@query(f"""WITH l AS (SELECT p_partkey, {_DEEP} AS n, unnest({_list(_LANGS)}) AS language FROM part)
SELECT language, count(*) AS callables, sum(n * (n + 1) / 2 + n + 3)::BIGINT AS total, max((n * (n + 1) / 2 + n + 3)::INT) AS most, 'complete' AS status FROM l GROUP BY ALL""")
def cognitive_by_language(spark, d):
    """Cognitive totals by language with the status of the files, not of the rows."""
    from sievework.functions.status import combined

    files = _planted(spark, d)
    state = files.groupBy("language").agg(combined(F.col("status")).alias("status"))
    rows = L.callables(files, ["language", "p_partkey"]).groupBy("language").agg(F.count("*").alias("callables"), F.sum("cognitive").alias("total"), F.max("cognitive").alias("most"))
    return rows.join(state, "language").select("language", "callables", "total", "most", "status")


@query()
def body_clones_lexical(spark, d):
    return L.body_groups(L.callables(_metrics(spark, d), _FILE), ["detected_language", "file_id"], "lexical")


@query()
def body_clones_structural(spark, d):
    return L.body_groups(L.callables(_metrics(spark, d), _FILE), ["detected_language", "file_id"], "structural")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
