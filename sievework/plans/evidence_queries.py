"""Queries of the evidence operators over the test tables, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import numbers as N
from sievework.functions import status as S
from sievework.functions import text as X
from sievework.functions.paths import hex_number, portable_path
from sievework.operators import aggregates as A
from sievework.operators import clones as C
from sievework.operators import diff as D
from sievework.operators import hotspots as H
from sievework.operators import policy as P
from sievework.operators import scope as K
from sievework.operators import spans as R
from sievework.operators.snapshots import BROADCAST_SNAPSHOTS
from sievework.session import cut, table

COUNTS = ["source_files_contribution", "lines_of_code", "classes_structs", "methods_functions"]
STATUSES = ["read_status", "loc_status", "classes_structs_status", "methods_functions_status"]
LANGUAGES = ("Java", "JavaScript", "TypeScript", "Python", "Go")
COMMENT = r"(#|//).*$"


def _ledger(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Ledger rows, each once."""
    return table(spark, d, "contributions").select("contribution_id", *columns).distinct()


def _sql_ledger(*columns: str) -> str:
    return f"(SELECT DISTINCT contribution_id, {', '.join(columns)} FROM contributions)"


_PORTABLE = "array_to_string(list_filter(string_split(replace(relative_path, '\\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/')"


def _sql_delivered(*fields: str) -> str:
    """The last delivery of each file of each run, by its portable path and its digest as a number; ties take the greatest values."""
    order = ", ".join(f"{f} DESC NULLS LAST" for f in ("ingested_at", *fields))
    return f"""raw AS (SELECT *, {_PORTABLE} AS path, regexp_extract(trim(content_sha256), '^(?:sha256:)?(?:0x)?([0-9a-f]+)$', 1, 'i') AS plain FROM contributions),
keyed AS (SELECT *, CASE WHEN plain <> '' THEN repeat('0', length(ltrim(plain, '0')) % 2) || lower(ltrim(plain, '0')) END AS digest FROM raw),
delivered AS (SELECT workspace_id, subject_key, run_id, path, {', '.join(fields)} FROM keyed
QUALIFY row_number() OVER (PARTITION BY workspace_id, subject_key, run_id, run_seq, path ORDER BY {order}) = 1)"""


def _sql_runs(name: str, *group: str) -> str:
    keys = "".join(f"{g}, " for g in group)
    return f"""runs AS (SELECT *, row_number() OVER w AS k, lead(run_id) OVER w AS next_run FROM (SELECT {keys}run_id, min(run_seq) AS seq FROM {name} WHERE run_id IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY {', '.join(group)} ORDER BY seq NULLS FIRST, run_id))"""


def _sql_steps(*fields: str) -> str:
    """Each file of each run beside itself in the subject's previous run."""
    side = lambda at, name: ", ".join(f"{at}.{f} AS {name}_{f}" for f in fields)
    none = ", ".join(f"NULL AS r_{f}" for f in fields)
    one = "a.workspace_id = b.workspace_id AND a.subject_key = b.subject_key AND a.path IS NOT DISTINCT FROM b.path AND a.k + 1 = b.k"
    return f"""WITH {_sql_delivered(*fields)}, {_sql_runs('contributions', 'workspace_id', 'subject_key')},
files AS (SELECT d.*, k, next_run FROM delivered d JOIN runs USING (workspace_id, subject_key, run_id)),
steps AS (SELECT b.workspace_id, b.subject_key, b.run_id, b.path, a.k IS NOT NULL AS was, true AS is_, {side('a', 'l')}, {side('b', 'r')} FROM files b LEFT JOIN files a ON {one} WHERE b.k > 1
UNION ALL SELECT a.workspace_id, a.subject_key, a.next_run, a.path, true, false, {side('a', 'l')}, {none} FROM files a LEFT JOIN files b ON {one} WHERE a.next_run IS NOT NULL AND b.k IS NULL)
"""


Q: dict = {}
SQL: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """Conditional counts come out as HUGEINT in DuckDB; the queries give BIGINT."""
    out, at = "", 0
    while (begin := sql.find("count_if(", at)) >= 0:
        end, depth = begin + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:begin] + sql[begin:end] + "::BIGINT"
        at = end
    return out + sql[at:]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = _bigint_counts(sql)
        return f

    return add


# -- lines and composition

_LINES = """
WITH l AS (SELECT lang, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM documents),
c AS (SELECT lang, count(*) AS total, count_if(trim(line, ' ') = '') AS blank, count_if(trim(line, ' ') <> '') AS nonblank,
  count_if(trim(line, ' ') <> '' AND trim(regexp_replace(line, '(#|//).*$', ''), ' ') <> '') AS code FROM l GROUP BY lang),
k AS (SELECT *, nonblank - code AS comment FROM c)
"""


@query(_LINES + "SELECT * FROM k")
def line_classes(spark, d):
    return A.line_classes(table(spark, d, "documents"), ["lang"], "text", COMMENT)


@query(_LINES + """SELECT lang, round(code / nullif(nonblank, 0), 4) AS code_ratio, round(comment / nullif(nonblank, 0), 4) AS comment_ratio,
round(blank / nullif(total, 0), 4) AS blank_ratio, code + comment = nonblank AS nonblank_holds, nonblank + blank = total AS total_holds FROM k""")
def composition_ratios(spark, d):
    return A.composition(line_classes(spark, d), ["lang"])


@query(f"""WITH r AS (SELECT workspace_id, subject_key, run_id, detected_language, {', '.join(f'sum({c})::BIGINT AS {c}' for c in COUNTS)}
FROM {_sql_ledger('workspace_id', 'subject_key', 'run_id', 'detected_language', *COUNTS)} GROUP BY ALL)
SELECT * FROM r UNION ALL SELECT workspace_id, subject_key, run_id, NULL, {', '.join(f'sum({c})::BIGINT' for c in COUNTS)} FROM r GROUP BY ALL""")
def component_rollup(spark, d):
    rows = _ledger(spark, d, "workspace_id", "subject_key", "run_id", "detected_language", *COUNTS)
    return A.component_rollup(rows, ["workspace_id", "subject_key", "run_id"], "detected_language", COUNTS)


@query(f"""WITH r AS (SELECT workspace_id, subject_key, run_id, detected_language, sum(lines_of_code) AS code, sum(source_files_contribution) AS files
FROM {_sql_ledger('workspace_id', 'subject_key', 'run_id', 'detected_language', 'lines_of_code', 'source_files_contribution')} GROUP BY ALL),
o AS (SELECT *, CASE detected_language {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LANGUAGES))} ELSE {len(LANGUAGES)} END AS place FROM r),
w AS (SELECT *, row_number() OVER v AS rn, coalesce(lead(code) OVER v = code AND lead(files) OVER v = files, false) AS tied FROM o
WINDOW v AS (PARTITION BY workspace_id, subject_key, run_id ORDER BY code DESC NULLS LAST, files DESC NULLS LAST, place, detected_language))
SELECT workspace_id, subject_key, run_id, detected_language AS primary_language, tied FROM w WHERE rn = 1""")
def primary_language(spark, d):
    subject = ["workspace_id", "subject_key", "run_id"]
    rows = _ledger(spark, d, *subject, "detected_language", "lines_of_code", "source_files_contribution")
    sums = rows.groupBy(*subject, "detected_language").agg(F.sum("lines_of_code").alias("code"), F.sum("source_files_contribution").alias("files"))
    return A.primary_language(sums, subject, "detected_language", "code", "files", LANGUAGES)


def _combined_sql(c: str) -> str:
    return f"CASE WHEN count({c}) = 0 THEN 'not_applicable' WHEN count_if({c} = 'failed') = count({c}) THEN 'failed' WHEN count_if({c} IN ('failed', 'partial')) > 0 THEN 'partial' ELSE 'complete' END"


_RANK = "CASE {0} WHEN 'not_applicable' THEN 0 WHEN 'complete' THEN 1 WHEN 'partial' THEN 2 WHEN 'failed' THEN 3 END"


@query(f"""WITH r AS (SELECT workspace_id, subject_key, run_id, {', '.join(f'{_combined_sql(s)} AS {s}' for s in STATUSES)}
FROM {_sql_ledger('workspace_id', 'subject_key', 'run_id', *STATUSES)} GROUP BY ALL)
SELECT *, CASE greatest({', '.join(_RANK.format(s) for s in STATUSES)}) WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' WHEN 3 THEN 'failed' END AS metric_status FROM r""")
def status_rollup(spark, d):
    keys = ["workspace_id", "subject_key", "run_id"]
    return A.status_rollup(_ledger(spark, d, *keys, *STATUSES), keys, STATUSES)


@query(f"""SELECT detected_language, parse_status, count(*) AS n, count_if(nloc_status IN ('complete', 'partial') AND lines_of_code IS NOT NULL) AS available
FROM {_sql_ledger('detected_language', 'parse_status', 'nloc_status', 'lines_of_code')} GROUP BY ALL""")
def metric_completeness(spark, d):
    rows = _ledger(spark, d, "detected_language", "parse_status", "nloc_status", "lines_of_code")
    there = S.completeness(F.col("nloc_status")).isin("complete", "partial") & F.col("lines_of_code").isNotNull()
    return rows.groupBy("detected_language", "parse_status").agg(F.count("*").alias("n"), F.count_if(there).alias("available"))


# -- aggregates and distributions


@query("""WITH g AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS v FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(v) AS evaluable, sum(v) AS total, round(avg(v), 4) AS mean, quantile_disc(v, 0.5) AS median, max(v) AS max FROM g GROUP BY ALL""")
def structural_aggregate(spark, d):
    return A.structural_aggregate(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_linestatus") == "F")


@query(f"""SELECT detected_language, parse_status, nullif(count(callable_count), 0) AS measured, sum(callable_count)::BIGINT AS total, round(avg(callable_count), 4) AS mean, max(callable_count) AS max
FROM {_sql_ledger('detected_language', 'parse_status', 'callable_count')} GROUP BY ALL""")
def cognitive_aggregate_nulls(spark, d):
    return A.nothing_measured(_ledger(spark, d, "detected_language", "parse_status", "callable_count"), ["detected_language", "parse_status"], "callable_count")


@query("""WITH c AS (SELECT l_returnflag, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, (sum(n) OVER (PARTITION BY l_returnflag ORDER BY value ROWS UNBOUNDED PRECEDING))::BIGINT AS running,
round((sum(n) OVER (PARTITION BY l_returnflag ORDER BY value ROWS UNBOUNDED PRECEDING)) / sum(n) OVER (PARTITION BY l_returnflag), 4) AS share FROM c""")
def cumulative_shares(spark, d):
    return A.frequency(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""WITH c AS (SELECT event_type, user_id AS value, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, value) AS place, greatest(count(*) OVER (PARTITION BY event_type) - 5, 0) AS hidden FROM c)
SELECT * FROM w WHERE place <= 5""")
def frequency_head(spark, d):
    return A.frequency_head(table(spark, d, "events"), ["event_type"], "user_id", 5).withColumn("place", F.col("place").cast("bigint")).withColumn("hidden", F.col("hidden").cast("bigint"))


_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(f"""WITH u AS ({' UNION ALL '.join(f"SELECT l_returnflag, '{f}' AS field, {f}::DOUBLE AS v FROM lineitem" for f in _FIELDS)})
SELECT l_returnflag, field, count(v) AS measured, count_if(v IS NULL) AS unmeasured, min(v) AS least, max(v) AS most, count(DISTINCT v) AS distinct_values,
{', '.join(f'quantile_disc(v, {p / 100}) AS p{p}' for p in A.POSITIONS)} FROM u GROUP BY ALL""")
def percentile_profile(spark, d):
    return A.distribution(table(spark, d, "lineitem"), ["l_returnflag"], _FIELDS)


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey) AS place FROM part WHERE p_retailprice IS NOT NULL)
SELECT * FROM r WHERE place <= 10""")
def rank_top10(spark, d):
    return A.top_rows(table(spark, d, "part"), ["p_brand"], "p_retailprice", [F.col("p_name"), F.col("p_partkey")], 10).select("p_brand", "p_partkey", "p_retailprice", F.col("place").cast("bigint").alias("place"))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS samples, median(value) AS median, max(CASE WHEN i = round_even(0.9 * (n - 1), 0) THEN value END) AS p90, max(CASE WHEN i = round_even(0.99 * (n - 1), 0) THEN value END) AS p99 FROM s GROUP BY ALL""")
def sample_profile(spark, d):
    return A.sample_profile(table(spark, d, "events"), ["event_type"], "value", {"p90": 0.9, "p99": 0.99})


_RECORDED = ["lines_of_code", "source_files", "classes_structs", "methods_functions"]


@query(f"""WITH parts AS (SELECT workspace_id, run_id, subject_key, detected_language, {', '.join(f'coalesce(sum({p}), 0)::BIGINT AS s_{r}, count_if({p} IS NULL) AS m_{r}' for p, r in zip(['lines_of_code', 'source_files_contribution', 'classes_structs', 'methods_functions'], _RECORDED))}
FROM {_sql_ledger('workspace_id', 'run_id', 'subject_key', 'detected_language', *COUNTS)} GROUP BY ALL),
rec AS (SELECT DISTINCT workspace_id, run_id, subject_key, detected_language, {', '.join(f"CASE WHEN regexp_matches(json_extract_string(record_json, '$.{r}'), '^[+-]?[0-9]+$') THEN TRY_CAST(json_extract_string(record_json, '$.{r}') AS BIGINT) END AS {r}" for r in _RECORDED)} FROM language_metrics),
u AS ({' UNION ALL '.join(f"SELECT r.workspace_id, r.run_id, r.subject_key, r.detected_language, '{r}' AS dimension, r.{r} AS recorded, p.s_{r} AS parts, p.m_{r} AS skipped FROM rec r LEFT JOIN parts p USING (workspace_id, run_id, subject_key, detected_language)" for r in _RECORDED)})
SELECT *, recorded - parts AS residual, CASE WHEN recorded IS NULL OR parts IS NULL THEN 'not_evaluable' WHEN recorded = parts THEN 'exact' ELSE 'residual' END AS outcome FROM u""")
def ledger_reconcile(spark, d):
    keys = ["workspace_id", "run_id", "subject_key", "detected_language"]
    parts = _ledger(spark, d, *keys, *COUNTS).withColumnRenamed("source_files_contribution", "source_files")
    recorded = table(spark, d, "language_metrics").select(*keys, *[N.strict_integer(F.get_json_object("record_json", f"$.{r}")).alias(r) for r in _RECORDED]).distinct()
    return A.reconcile(recorded.withColumn("status", F.lit("complete")), parts, keys, _RECORDED, "status")


@query(f"""SELECT workspace_id, subject_key, run_id, CASE WHEN count_if(lines_of_code IS NULL) = 0 THEN sum(lines_of_code)::BIGINT END AS lines_of_code,
CASE WHEN count_if(callable_count IS NULL) = 0 THEN sum(callable_count)::BIGINT END AS callable_count
FROM {_sql_ledger('workspace_id', 'subject_key', 'run_id', 'lines_of_code', 'callable_count')} GROUP BY ALL""")
def poisoned_totals(spark, d):
    keys = ["workspace_id", "subject_key", "run_id"]
    return A.poisoned_totals(_ledger(spark, d, *keys, "lines_of_code", "callable_count"), keys, ["lines_of_code", "callable_count"])


# -- joins


@query("""WITH f AS (SELECT DISTINCT workspace_id, lower(content_sha256) AS h FROM source_files WHERE content_sha256 IS NOT NULL),
c AS (SELECT DISTINCT workspace_id, run_id, relative_path, lower(content_sha256) AS h FROM contributions WHERE content_sha256 IS NOT NULL)
SELECT c.workspace_id, c.run_id, count(*) AS files, count(f.h) AS with_text FROM c LEFT JOIN f ON c.workspace_id = f.workspace_id AND c.h = f.h GROUP BY ALL""")
def ledger_text_coverage(spark, d):
    h = F.lower("content_sha256").alias("h")
    texts = table(spark, d, "source_files").where("content_sha256 is not null").select("workspace_id", h).distinct().withColumn("there", F.lit(1))
    rows = table(spark, d, "contributions").where("content_sha256 is not null").select("workspace_id", "run_id", "relative_path", h).distinct()
    return rows.join(texts, ["workspace_id", "h"], "left").groupBy("workspace_id", "run_id").agg(F.count("*").alias("files"), F.count("there").alias("with_text"))


# -- hotspots

_HOT = "WITH " + _sql_delivered("source_files_contribution", "detected_language", "callable_count", "digest") + """,
files AS (SELECT DISTINCT workspace_id, subject_key, detected_language, path FROM delivered WHERE source_files_contribution = 1),
held AS (SELECT workspace_id, subject_key, path, max(callable_count) AS complexity, nullif(count(DISTINCT digest), 0) AS churn FROM delivered GROUP BY ALL),
j AS (SELECT f.*, complexity, churn FROM files f LEFT JOIN held USING (workspace_id, subject_key, path)),
r AS (SELECT *, CASE WHEN complexity IS NOT NULL THEN dense_rank() OVER (PARTITION BY workspace_id, subject_key, detected_language, complexity IS NULL ORDER BY complexity) - 1 END AS i1,
 CASE WHEN churn IS NOT NULL THEN dense_rank() OVER (PARTITION BY workspace_id, subject_key, churn IS NULL ORDER BY churn) - 1 END AS i2 FROM j),
m AS (SELECT *, max(i1) OVER (PARTITION BY workspace_id, subject_key, detected_language) AS d1, max(i2) OVER (PARTITION BY workspace_id, subject_key) AS d2 FROM r),
s AS (SELECT workspace_id, subject_key, detected_language, path, complexity, churn,
 CASE WHEN i1 IS NULL THEN NULL WHEN d1 = 0 THEN 'medium' WHEN i1 * 2 // d1 = 0 THEN 'low' WHEN i1 * 2 // d1 = 1 THEN 'medium' ELSE 'high' END AS complexity_signal,
 CASE WHEN i2 IS NULL THEN NULL WHEN d2 = 0 THEN 'medium' WHEN i2 * 2 // d2 = 0 THEN 'low' WHEN i2 * 2 // d2 = 1 THEN 'medium' ELSE 'high' END AS churn_signal FROM m),
h AS (SELECT *, CASE WHEN complexity_signal IS NULL OR churn_signal IS NULL THEN NULL WHEN complexity_signal = 'high' AND churn_signal = 'high' THEN 'high'
 WHEN complexity_signal = 'high' OR churn_signal = 'high' OR (complexity_signal = 'medium' AND churn_signal = 'medium') THEN 'moderate' ELSE 'low' END AS attention FROM s)
"""


@query(_HOT + "SELECT * FROM h")
def attention_hotspots(spark, d):
    rows = _delivered(spark, d, "source_files_contribution", "detected_language", "callable_count", "digest")
    key = ["workspace_id", "subject_key", "path"]
    # One row a file, cut off before the signals: they read it several times.
    languages = F.collect_set(F.when(F.col("source_files_contribution") == 1, F.struct("detected_language"))).alias("languages")
    held = cut(rows.groupBy(*key).agg(languages, F.max("callable_count").alias("complexity"), F.nullif(F.size(F.collect_set("digest")), F.lit(0)).cast("bigint").alias("churn")))
    files = held.select(*key, F.inline("languages"))
    complexity, churn = held.select(*key, "complexity"), held.select(*key, "churn")
    out = H.hotspots(files, complexity, churn, key, complexity_cohort=["workspace_id", "subject_key", "detected_language"], churn_cohort=["workspace_id", "subject_key"])
    return out.select("workspace_id", "subject_key", "detected_language", "path", "complexity", "churn", "complexity_signal", "churn_signal", "attention")


@query(_HOT + """, labels AS (SELECT unnest(['high', 'moderate', 'low', 'unclassified']) AS label), subjects AS (SELECT DISTINCT workspace_id, subject_key FROM h),
c AS (SELECT workspace_id, subject_key, coalesce(attention, 'unclassified') AS label, count(*) AS n FROM h GROUP BY ALL)
SELECT s.workspace_id, s.subject_key, l.label, coalesce(n, 0) AS n FROM subjects s CROSS JOIN labels l LEFT JOIN c USING (workspace_id, subject_key, label)""")
def attention_counts(spark, d):
    return A.label_counts(attention_hotspots(spark, d), ["workspace_id", "subject_key"], "attention", H.ATTENTION)


# -- windows and identity


@query("""WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents WHERE text IS NOT NULL)
SELECT doc_id, representative, rn > 1 AS duplicate FROM r""")
def first_occurrence(spark, d):
    # The representative of a text is found by aggregation over digests, not by sorting all copies in one task.
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    first = docs.groupBy("h", "n").agg(F.min("doc_id").alias("representative"))
    return docs.join(first, ["h", "n"]).select("doc_id", "representative", (F.col("doc_id") != F.col("representative")).alias("duplicate"))


@query("""WITH w AS (SELECT c_custkey, count(*) OVER p AS n, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer WINDOW p AS (PARTITION BY c_mktsegment, c_nationkey))
SELECT c_custkey, CASE WHEN n > 1 THEN k END AS ordinal FROM w""")
def colliding_ordinals(spark, d):
    p = Window.partitionBy("c_mktsegment", "c_nationkey")
    rows = table(spark, d, "customer").select("c_custkey", F.count("*").over(p).alias("n"), F.row_number().over(p.orderBy("c_custkey")).alias("k"))
    return rows.select("c_custkey", F.when(F.col("n") > 1, (F.col("k") - 1).cast("bigint")).alias("ordinal"))


_SPANS = """WITH s AS (SELECT l_suppkey AS path, l_orderkey AS id, l_partkey % 1000 + l_linenumber AS s0, l_partkey % 1000 + l_linenumber + l_quantity::BIGINT % 7 AS e0 FROM lineitem)
"""


def _spans(spark, d):
    start = F.col("l_partkey") % 1000 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("id"), start.alias("s0"), (start + F.col("l_quantity").cast("bigint") % 7).alias("e0"))


@query(_SPANS + """, f AS (SELECT *, max(e0) OVER (PARTITION BY path ORDER BY s0, e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
i AS (SELECT *, sum(CASE WHEN far IS NULL OR s0 > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s0, e0 ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT path, min(s0) AS start, max(e0) AS "end", count(*) AS spans FROM i GROUP BY path, island""")
def span_union(spark, d):
    return R.span_union(_spans(spark, d), ["path"], "s0", "e0")


@query(_SPANS + """SELECT a.path, count(*) AS violations FROM s a JOIN s b ON a.path = b.path AND a.s0 < b.s0 AND b.s0 <= a.e0 AND a.e0 < b.e0 GROUP BY a.path""")
def laminar_violations(spark, d):
    return R.laminar_violations(_spans(spark, d), ["path"], "id", "s0", "e0").groupBy("path").agg(F.count("*").alias("violations"))


@query(_SPANS + """, h AS (SELECT o_custkey % 100 + 1 AS path, o_orderkey % 1000 AS h0, o_orderkey % 4 AS k FROM orders)
SELECT mode, count(*) AS pairs, count(DISTINCT id) AS spans FROM (SELECT id, CASE WHEN k = 0 THEN 'zero_length_anchor' ELSE 'interval_intersection' END AS mode
FROM s JOIN h USING (path) WHERE CASE WHEN k = 0 THEN s0 <= h0 AND h0 <= e0 ELSE s0 <= h0 + k - 1 AND h0 <= e0 END) GROUP BY ALL""")
def hunk_overlap(spark, d):
    hunks = table(spark, d, "orders").select((F.col("o_custkey") % 100 + 1).alias("path"), (F.col("o_orderkey") % 1000).alias("at"), (F.col("o_orderkey") % 4).alias("count"))
    spans = _spans(spark, d).withColumnsRenamed({"s0": "start", "e0": "end"})
    return R.hunk_overlap(spans, hunks, ["path"]).groupBy("mode").agg(F.count("*").alias("pairs"), F.countDistinct("id").alias("spans"))


# -- snapshots

_EVIDENCE = """, e AS (SELECT workspace_id, subject_key, run_id, path, l_digest AS left_digest, r_digest AS right_digest,
 CASE WHEN NOT was THEN 'added' WHEN NOT is_ THEN 'removed' WHEN l_digest IS NULL OR r_digest IS NULL THEN 'indeterminate' WHEN l_digest = r_digest THEN 'unchanged' ELSE 'changed' END AS state, {} FROM steps)
"""
_FILE = ["workspace_id", "subject_key", "path"]
_SUBJECT = ["workspace_id", "subject_key"]


def _delivered(spark, d, *fields: str) -> DataFrame:
    """Each file of each run once: portable path, digest as a number, the row that arrived last.

    Rows that tie in arrival are taken by their greatest values.
    """
    rows = table(spark, d, "contributions").withColumn("path", portable_path(F.col("relative_path"))).withColumn("digest", hex_number(F.col("content_sha256")))
    rows = rows.repartition(*_FILE)  # one exchange serves the deliveries and the runs of a file
    last = F.max_by(F.struct(*fields), F.struct("ingested_at", *fields)).alias("last")
    return rows.groupBy("workspace_id", "subject_key", "run_id", "run_seq", "path").agg(last).select("workspace_id", "subject_key", "run_id", "run_seq", "path", "last.*")


def _numbered(spark, d, name: str, group: list[str]) -> DataFrame:
    runs = cut(D.numbered_runs(table(spark, d, name), group, "run_id", "run_seq"))
    return F.broadcast(runs) if runs.count() <= BROADCAST_SNAPSHOTS else runs


def _steps(spark, d, *fields: str) -> DataFrame:
    """Each file of each run beside itself in the subject's previous run."""
    rows = D.with_runs(_delivered(spark, d, *fields), _numbered(spark, d, "contributions", _SUBJECT), _SUBJECT, "run_id")
    return D.steps(rows, _SUBJECT, "run_id", "path", [*fields])


@query(_sql_steps("digest") + _EVIDENCE.format("1") + "SELECT workspace_id, subject_key, run_id, path, left_digest, right_digest, state FROM e")
def snapshot_diff(spark, d):
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return D.step_evidence(_steps(spark, d, "digest"), "digest").select(*_SUBJECT, "run_id", "path", hexed("left_digest"), hexed("right_digest"), "state")


@query(_sql_steps("digest") + _EVIDENCE.format("1") + """, o AS (SELECT workspace_id, subject_key, run_id, left_digest AS digest, count(*) AS n_old, min(path) AS old_path FROM e WHERE state = 'removed' AND left_digest IS NOT NULL GROUP BY ALL),
n AS (SELECT workspace_id, subject_key, run_id, right_digest AS digest, count(*) AS n_new, min(path) AS new_path FROM e WHERE state = 'added' AND right_digest IS NOT NULL GROUP BY ALL)
SELECT workspace_id, subject_key, run_id, digest, CASE WHEN n_old = 1 AND n_new = 1 THEN 'exact' ELSE 'ambiguous' END AS kind, CASE WHEN n_old = 1 AND n_new = 1 THEN old_path END AS old_path,
CASE WHEN n_old = 1 AND n_new = 1 THEN new_path END AS new_path, n_old, n_new FROM o JOIN n USING (workspace_id, subject_key, run_id, digest)""")
def exact_renames(spark, d):
    return D.exact_renames(snapshot_diff(spark, d), [*_SUBJECT, "run_id"], "path")


@query(_sql_steps("digest", "lines_of_code") + _EVIDENCE.format("l_lines_of_code AS l, r_lines_of_code AS r") + """SELECT workspace_id, subject_key, run_id, coalesce(sum(CASE WHEN state = 'added' THEN r END), 0)::BIGINT AS added, coalesce(sum(CASE WHEN state = 'removed' THEN l END), 0)::BIGINT AS removed,
coalesce(sum(CASE WHEN state = 'changed' THEN r - l END), 0)::BIGINT AS changed, CASE WHEN miss = 0 THEN delta END AS delta, CASE WHEN miss = 0 THEN (delta - (added - removed + changed))::BIGINT END AS residual,
CASE WHEN miss > 0 THEN 'not_evaluable' WHEN delta = added - removed + changed THEN 'exact_reconciliation' ELSE 'unexplained_residual' END AS outcome
FROM (SELECT *, (sum(coalesce(r, 0) - coalesce(l, 0)) OVER w)::BIGINT AS delta, sum(CASE WHEN (state IN ('added', 'changed', 'unchanged') AND r IS NULL) OR (state IN ('removed', 'changed', 'unchanged') AND l IS NULL) THEN 1 ELSE 0 END) OVER w AS miss
FROM e WINDOW w AS (PARTITION BY workspace_id, subject_key, run_id)) GROUP BY workspace_id, subject_key, run_id, delta, miss""")
def delta_attribution(spark, d):
    rows = D.step_evidence(_steps(spark, d, "digest", "lines_of_code"), "digest")
    rows = rows.withColumns({"l_value": F.col("before.lines_of_code"), "r_value": F.col("after.lines_of_code")})
    return D.attribute_rows(rows, [*_SUBJECT, "run_id"])


@query("""WITH y AS (SELECT year(o_orderdate) AS year, o_orderpriority, count(*)::DOUBLE AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL),
n AS (SELECT year, lead(year) OVER (ORDER BY year) AS next_year, row_number() OVER (ORDER BY year) AS k FROM (SELECT DISTINCT year FROM y)),
a AS (SELECT next_year AS year, o_orderpriority, orders, revenue FROM y JOIN n USING (year) WHERE next_year IS NOT NULL), b AS (SELECT y.* FROM y JOIN n USING (year) WHERE k > 1),
j AS (SELECT coalesce(a.year, b.year) AS year, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.year IS NULL OR b.year IS NULL AS absent, a.orders AS lo, b.orders AS ro, a.revenue AS lr, b.revenue AS rr
FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority AND a.year = b.year),
u AS (SELECT year, o_orderpriority, 'orders' AS dimension, lo AS before, ro AS after, absent FROM j UNION ALL SELECT year, o_orderpriority, 'revenue', lr, rr, absent FROM j)
SELECT year::INT AS year, o_orderpriority, dimension, before, after, round(after - before, 2) AS delta, CASE WHEN absent THEN 'side_absent' WHEN before IS NULL OR after IS NULL THEN 'measurement_unavailable' END AS reason FROM u WHERE after - before IS NULL OR after <> before""")
def metric_deltas(spark, d):
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    sums = rows.groupBy("year", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    left, right = D.sides(D.with_runs(sums, D.numbered_runs(rows, [], "year", "year"), [], "year"), "year")
    return D.deltas(left, right, ["year", "o_orderpriority"], ["orders", "revenue"]).withColumn("delta", F.round("delta", 2))


_CONTRIBUTION_RUNS = _sql_runs("contributions", "workspace_id", "subject_key")


@query(f"""WITH {_CONTRIBUTION_RUNS}, g AS (SELECT workspace_id, subject_key, detected_language, run_id, sum(lines_of_code)::DOUBLE AS v1, sum(callable_count)::DOUBLE AS v2
FROM {_sql_ledger('workspace_id', 'subject_key', 'detected_language', 'run_id', 'lines_of_code', 'callable_count')} GROUP BY ALL),
n AS (SELECT g.*, k, next_run FROM g JOIN runs USING (workspace_id, subject_key, run_id)), a AS (SELECT * EXCLUDE (run_id), next_run AS run_id FROM n WHERE next_run IS NOT NULL), b AS (SELECT * FROM n WHERE k > 1),
j AS (SELECT workspace_id, subject_key, run_id, detected_language, a.k IS NULL OR b.k IS NULL AS absent, a.v1 AS l1, b.v1 AS r1, a.v2 AS l2, b.v2 AS r2 FROM a FULL JOIN b USING (workspace_id, subject_key, run_id, detected_language)),
u AS (SELECT workspace_id, subject_key, run_id, detected_language, 'lines_of_code' AS dimension, l1 AS before, r1 AS after, absent FROM j UNION ALL SELECT workspace_id, subject_key, run_id, detected_language, 'callable_count', l2, r2, absent FROM j)
SELECT workspace_id, subject_key, run_id, detected_language, dimension, before, after, after - before AS delta, CASE WHEN absent THEN 'side_absent' WHEN before IS NULL OR after IS NULL THEN 'measurement_unavailable' END AS reason FROM u WHERE after - before IS NULL OR after <> before""")
def language_deltas(spark, d):
    keys = ["workspace_id", "subject_key", "detected_language"]

    rows = _ledger(spark, d, *keys, "run_id", "lines_of_code", "callable_count").groupBy(*keys, "run_id")
    sums = rows.agg(F.sum("lines_of_code").alias("lines_of_code"), F.sum("callable_count").alias("callable_count"))
    left, right = D.sides(D.with_runs(sums, _numbered(spark, d, "contributions", _SUBJECT), _SUBJECT, "run_id"), "run_id")
    return D.deltas(left, right, [*_SUBJECT, "run_id", "detected_language"], ["lines_of_code", "callable_count"])


_FIELDS_WATCHED = ("parse_status", "contribution_state", "analyzed_sha")


@query(_sql_steps(*_FIELDS_WATCHED) + f""", u AS ({' UNION ALL '.join(f"SELECT workspace_id, subject_key, run_id, path, '{f}' AS field, l_{f} AS before, r_{f} AS after FROM steps WHERE was AND is_" for f in _FIELDS_WATCHED)})
SELECT * FROM u WHERE before IS DISTINCT FROM after""")
def status_transitions(spark, d):
    fields = ["parse_status", "contribution_state", "analyzed_sha"]
    both = _steps(spark, d, *fields).where("before is not null and after is not null")
    both = both.withColumns({f"{side}_{f}": F.col(f"{at}.{f}") for side, at in (("l", "before"), ("r", "after")) for f in fields})
    return D.transitions_of(both, [*_SUBJECT, "run_id", "path"], fields)


_DIFFERS = "a.{0} IS DISTINCT FROM b.{0}"


@query(f"""WITH {_sql_runs('language_metrics', 'workspace_id')}, v AS (SELECT workspace_id, run_id, max(artifact_schema_version) AS schema_version, max(metric_contract_version) AS contract_version FROM language_metrics GROUP BY ALL),
n AS (SELECT v.*, k, next_run FROM v JOIN runs USING (workspace_id, run_id))
SELECT b.workspace_id, b.run_id, CASE WHEN {_DIFFERS.format('contract_version')} THEN 'incomparable' WHEN {_DIFFERS.format('schema_version')} THEN 'qualified' ELSE 'comparable' END AS verdict,
concat_ws(',', CASE WHEN {_DIFFERS.format('contract_version')} THEN 'contract_version' END, CASE WHEN {_DIFFERS.format('schema_version')} THEN 'schema_version' END) AS differences
FROM n a JOIN n b ON a.workspace_id = b.workspace_id AND a.k + 1 = b.k""")
def comparability_verdict(spark, d):
    rows = table(spark, d, "language_metrics").groupBy("workspace_id", "run_id")
    versions = rows.agg(F.max("artifact_schema_version").alias("schema_version"), F.max("metric_contract_version").alias("contract_version"))
    left, right = D.sides(D.with_runs(versions, _numbered(spark, d, "language_metrics", ["workspace_id"]), ["workspace_id"], "run_id"), "run_id")
    return D.comparability(left, right, ["workspace_id", "run_id"], ["contract_version"], ["schema_version"])


# -- clones

_CLONES = r"""WITH t AS (SELECT lang AS language, coalesce(source, '') AS path, doc_id, trim(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS content FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, 'sha256:' || sha256(unhex(printf('%016x', NAMESPACE_LENGTH)) || encode('sievework-clone-fingerprint') || unhex(printf('%016x', strlen(coalesce(language, '')))) || encode(coalesce(language, '')) || unhex(printf('%016x', strlen(content))) || encode(content)) AS fingerprint FROM t WHERE content <> ''),
g AS (SELECT language, fingerprint, content, count(*) AS occurrences, count(DISTINCT path) AS paths FROM f GROUP BY ALL HAVING count(*) >= 2)
"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("")).alias("path"), "text")


@query(_CLONES.replace("NAMESPACE_LENGTH", str(len(C.NAMESPACE))) + "SELECT language, fingerprint, occurrences, paths, CASE WHEN paths = 1 THEN 'same_file' WHEN paths = occurrences THEN 'cross_file' ELSE 'mixed' END AS distribution FROM g")
def clone_groups_lexical(spark, d):
    return C.group_clones(_docs(spark, d), "lang", "path", C.canonical_text(F.col("text")))


@query(_CLONES.replace("NAMESPACE_LENGTH", str(len(C.NAMESPACE))) + "SELECT doc_id, fingerprint, 'do1:' || sha256(unhex(printf('%016x', strlen(doc_id::VARCHAR))) || encode(doc_id::VARCHAR)) AS occurrence_id FROM f WHERE fingerprint IN (SELECT fingerprint FROM g)")
def clone_occurrences(spark, d):
    docs = _docs(spark, d)
    content = C.canonical_text(F.col("text"))
    return C.occurrence_ids(docs, C.group_clones(docs, "lang", "path", content), "lang", ["doc_id"], content)


@query("SELECT 'C' || p_partkey AS child, 'P' || p_partkey AS parent FROM part WHERE p_partkey % 4 IN (0, 3)")
def clone_suppression(spark, d):
    """Two groups a part, each in two files: the inner one is dominated if both its bodies lie strictly in bodies of the outer one."""
    part, k = table(spark, d, "part"), F.col("p_partkey") % 4
    item = lambda g, f, a, b: F.struct(F.concat(F.lit(g), "p_partkey").alias("grp"), F.lit("method").alias("kind"), F.concat(F.lit(f), "p_partkey").alias("path"), a.alias("start"), b.alias("end"))
    one = F.lit(1)
    # 1: the second inner body lies elsewhere; 2: the spans are equal; 3: both inner bodies share a file with two outer ones.
    outer2, inner2 = F.when(k == 3, "a").otherwise("b"), F.when(k == 1, 60).when(k == 2, 1).when(k == 3, 101).otherwise(10)
    rows = F.array(
        item("P", "a", one, F.lit(50)), F.struct(F.concat(F.lit("P"), "p_partkey").alias("grp"), F.lit("method").alias("kind"), F.concat(outer2, "p_partkey").alias("path"), F.when(k == 3, 100).otherwise(1).alias("start"), F.when(k == 3, 150).otherwise(50).alias("end")),
        item("C", "a", F.when(k == 2, 1).otherwise(10), F.when(k == 2, 50).otherwise(20)), F.struct(F.concat(F.lit("C"), "p_partkey").alias("grp"), F.lit("method").alias("kind"), F.concat(outer2, "p_partkey").alias("path"), inner2.alias("start"), F.when(k == 1, 70).when(k == 2, 50).when(k == 3, 140).otherwise(20).alias("end")),
    )
    return C.suppress_dominated(part.select(F.inline(rows)))


# -- scope and markers


_EXT = "lower(regexp_extract(slashed, '\\.([^./]+)$', 1))"


@query(f"""WITH p AS (SELECT DISTINCT relative_path, replace(relative_path, '\\', '/') AS slashed FROM contributions)
SELECT relative_path, CASE {' '.join(f"WHEN {_EXT} = '{e}' THEN '{x}'" for e, x in K.LANGUAGE_OF.items())} END AS language, regexp_matches(slashed, '^(src/.*|.*/test_[^/]*|.*\\.jsx)$') AS matched,
{_PORTABLE} AS portable FROM p""")
def path_predicates(spark, d):
    rows = table(spark, d, "contributions").select("relative_path").distinct()
    path = F.col("relative_path")
    slashed = F.translate(path, "\\", "/")
    return rows.select(path, K.language_of(slashed).alias("language"), slashed.rlike(r"^(src/.*|.*/test_[^/]*|.*\.jsx)$").alias("matched"), portable_path(path).alias("portable"))


@query("""WITH t AS (SELECT doc_id, text, regexp_matches(text, '\\r\\n') AS crlf, regexp_matches(replace(text, chr(13) || chr(10), ''), '\\n') AS lf, regexp_matches(replace(text, chr(13) || chr(10), ''), '\\r') AS cr FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN crlf::INT + lf::INT + cr::INT = 0 THEN 'none' WHEN crlf::INT + lf::INT + cr::INT > 1 THEN 'mixed' WHEN crlf THEN 'crlf' WHEN lf THEN 'lf' ELSE 'cr' END AS endings FROM t""")
def line_endings(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", K.line_endings(F.col("text")).alias("endings"))


# -- policy

_RULES = [
    ("long-subject", "lines_of_code", "gt", 2000.0, "allowed"),
    ("no-code", "lines_of_code", "eq", 0.0, "allowed"),
    ("many-callables", "callable_count", "gte", 900.0, "not_evaluable"),
    ("few-files", "files", "lt", 5.0, "allowed"),
]
_RULE_SQL = "(VALUES " + ", ".join(f"('{r}', '{m}', '{o}', {t}::DOUBLE, '{p}')" for r, m, o, t, p in _RULES) + ") AS rules(rule_id, metric, operator, threshold, partial_data)"
_OBS = f"""o AS (SELECT workspace_id, subject_key, run_id, count(*)::DOUBLE AS files, sum(lines_of_code)::DOUBLE AS lines_of_code, sum(callable_count)::DOUBLE AS callable_count,
CASE WHEN count_if(nloc_status = 'failed') = count(*) THEN 'unavailable' WHEN count_if(nloc_status IN ('failed', 'partial')) > 0 THEN 'partial' ELSE 'complete' END AS c
FROM {_sql_ledger('workspace_id', 'subject_key', 'run_id', 'nloc_status', 'lines_of_code', 'callable_count')} GROUP BY ALL),
u AS (SELECT workspace_id, subject_key, run_id, 'files' AS metric, files AS value, 'complete' AS completeness FROM o UNION ALL SELECT workspace_id, subject_key, run_id, 'lines_of_code', lines_of_code, c FROM o UNION ALL SELECT workspace_id, subject_key, run_id, 'callable_count', callable_count, c FROM o),
j AS (SELECT rule_id, workspace_id, subject_key, run_id, u.metric, value AS observed, CASE WHEN completeness IS NULL THEN 'measurement_absent' WHEN completeness = 'unavailable' THEN 'measurement_unavailable'
 WHEN completeness = 'partial' AND partial_data = 'not_evaluable' THEN 'partial_data_refused' WHEN value IS NULL THEN 'measurement_unavailable' END AS reason,
 CASE operator WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold WHEN 'eq' THEN value = threshold END AS fires FROM u JOIN {_RULE_SQL} ON u.metric = rules.metric),
f AS (SELECT rule_id, workspace_id, subject_key, run_id, metric, observed, CASE WHEN reason IS NOT NULL THEN 'not_evaluable' WHEN fires THEN 'violated' ELSE 'passed' END AS status, reason FROM j)
"""


def _findings(spark, d):
    keys = ["workspace_id", "subject_key", "run_id"]
    rows = _ledger(spark, d, *keys, "nloc_status", "lines_of_code", "callable_count")
    failed, bad = F.count_if(F.col("nloc_status") == "failed"), F.count_if(F.col("nloc_status").isin("failed", "partial"))
    state = F.when(failed == F.count("*"), "unavailable").when(bad > 0, "partial").otherwise("complete")
    sums = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("files"), F.sum("lines_of_code").cast("double").alias("lines_of_code"), F.sum("callable_count").cast("double").alias("callable_count"), state.alias("c"))
    item = lambda m, c: F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), c.alias("completeness"))
    long = sums.select(*keys, F.explode(F.array(item("files", F.lit("complete")), item("lines_of_code", F.col("c")), item("callable_count", F.col("c")))).alias("x")).select(*keys, "x.*")
    rules = spark.createDataFrame(_RULES, "rule_id string, metric string, operator string, threshold double, partial_data string")
    return P.judge(long, rules, keys)


@query("WITH " + _OBS + "SELECT *, CASE WHEN status = 'violated' AND (rule_id = 'few-files' OR (rule_id = 'long-subject' AND subject_key LIKE 'repo:atlas%')) THEN CASE rule_id WHEN 'few-files' THEN 'w1' ELSE 'w2' END END AS waiver_id FROM f")
def policy_findings(spark, d):
    waivers = spark.createDataFrame(
        [(1, "w1", "few-files", None, None), (2, "w2", "long-subject", "repo:atlas-monorepo/kernel", datetime.date(2999, 1, 1)), (3, "w0", "no-code", None, datetime.date(2020, 1, 1)), (4, "w3", "few-files", None, None)],
        "place int, waiver_id string, rule_id string, subject string, expires_on date",
    )
    return P.waive(_findings(spark, d), waivers, "subject_key", F.lit(datetime.date(2025, 6, 1)))


@query("WITH " + _OBS + f"SELECT rule_id, {', '.join(f'count_if(status = {s!r}) AS {s}' for s in P.STATUSES)} FROM f GROUP BY ALL")
def policy_tallies(spark, d):
    return P.tallies(_findings(spark, d))


@query("WITH " + _OBS + "SELECT rule_id, workspace_id, reason, count(*) AS n FROM f WHERE status = 'not_evaluable' GROUP BY ALL")
def policy_collapsed(spark, d):
    return P.collapse(_findings(spark, d), ["workspace_id"])


@query(f"""WITH {_CONTRIBUTION_RUNS}, s AS (SELECT workspace_id, subject_key, detected_language, run_id, sum(lines_of_code)::DOUBLE AS value, CASE WHEN count_if(nloc_status IN ('failed', 'partial')) > 0 THEN 'partial' ELSE 'complete' END AS completeness
FROM {_sql_ledger('workspace_id', 'subject_key', 'detected_language', 'run_id', 'lines_of_code', 'nloc_status')} GROUP BY ALL),
pairs AS (SELECT b.workspace_id, b.subject_key, b.run_id, a.run_id AS baseline_run_id FROM runs a JOIN runs b ON a.workspace_id = b.workspace_id AND a.subject_key = b.subject_key AND a.k < b.k AND (a.k = 1 OR a.k + 1 = b.k)),
b AS (SELECT p.*, detected_language, value FROM pairs p JOIN s ON p.workspace_id = s.workspace_id AND p.subject_key = s.subject_key AND p.baseline_run_id = s.run_id),
c AS (SELECT p.*, detected_language, value, completeness FROM pairs p JOIN s USING (workspace_id, subject_key, run_id))
SELECT workspace_id, subject_key, run_id, baseline_run_id, detected_language, b.value AS baseline, c.value AS current, c.value - b.value AS delta,
CASE WHEN b.workspace_id IS NULL THEN 'extra' WHEN c.workspace_id IS NULL THEN 'missing' WHEN c.completeness <> 'complete' THEN c.completeness WHEN c.value - b.value IS NULL THEN 'unavailable'
WHEN c.value = b.value THEN 'unchanged' WHEN c.value < b.value THEN 'improved' WHEN c.value - b.value <= 20 THEN 'tolerated' ELSE 'regression' END AS decision FROM b FULL JOIN c USING (workspace_id, subject_key, run_id, baseline_run_id, detected_language)""")
def ratchet_compare(spark, d):
    keys = ["workspace_id", "subject_key", "detected_language"]

    bad = F.count_if(F.col("nloc_status").isin("failed", "partial")) > 0
    rows = _ledger(spark, d, *keys, "run_id", "lines_of_code", "nloc_status").groupBy(*keys, "run_id")
    sums = rows.agg(F.sum("lines_of_code").cast("double").alias("value"), F.when(bad, "partial").otherwise("complete").alias("completeness"))
    runs = _numbered(spark, d, "contributions", _SUBJECT)
    sums = cut(D.with_runs(sums, runs, _SUBJECT, "run_id"))
    # Each run against the run before and, from the third on, against the first: small steps may add up to a regression.
    _, current = D.sides(sums, "run_id")
    last = sums.where("next_run is not null").withColumns({"baseline_run_id": F.col("run_id"), "run_id": F.col("next_run")}).drop("k", "next_run", "completeness")
    later = runs.where("k > 2").select(*_SUBJECT, F.col("run_id").alias("at"))
    first = sums.where("k = 1").drop("k", "next_run", "completeness").withColumnRenamed("run_id", "baseline_run_id").join(later, _SUBJECT).withColumnRenamed("at", "run_id")
    pairs = runs.where("next_run is not null").select(*_SUBJECT, F.col("next_run").alias("run_id"), F.col("run_id").alias("baseline_run_id"))
    firsts = runs.where("k = 1").select(*_SUBJECT, F.col("run_id").alias("baseline_run_id")).join(later, _SUBJECT).withColumnRenamed("at", "run_id")
    current = current.join(pairs.unionByName(firsts), [*_SUBJECT, "run_id"])
    return P.ratchet(last.unionByName(first), current, [*_SUBJECT, "run_id", "baseline_run_id", "detected_language"], allowed=20.0)


# -- front end and scalars


@query("""SELECT DISTINCT artifact_schema_version AS declared, regexp_matches(artifact_schema_version, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$') AS strict,
CASE WHEN regexp_matches(artifact_schema_version, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$') THEN split_part(artifact_schema_version, '.', 2)::INT END AS minor FROM language_metrics""")
def declared_versions(spark, d):
    rows = table(spark, d, "language_metrics").select(F.col("artifact_schema_version").alias("declared")).distinct()
    parts = N.version_parts(F.col("declared"))
    return rows.select("declared", F.when(F.col("declared").isNotNull(), parts.isNotNull()).alias("strict"), parts["minor"].alias("minor"))


@query("""SELECT DISTINCT repository_url, CASE WHEN repository_url IS NOT NULL THEN 'repo:' || regexp_replace(regexp_replace(repository_url, '^[a-z]+://[^/]+/', ''), '(\\.git)?/?$', '') END AS subject, replace(replace(repository_url, '&', '&amp;'), '<', '&lt;') AS html FROM contributions""")
def subject_keys(spark, d):
    rows = table(spark, d, "contributions").select("repository_url").distinct()
    return rows.select("repository_url", X.subject_of_url(F.col("repository_url")).alias("subject"), X.escape_html(F.col("repository_url")).alias("html"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
