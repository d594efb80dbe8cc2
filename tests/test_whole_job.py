"""Registered queries over small tables of their own: every row counts and spellings of one thing are one thing."""

import datetime as dt
import json
from collections import Counter

import pytest

from sievework.operators.drift import ingest, promote
from sievework.plans import evidence_queries as E

EARLY, LATE = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
LEDGER = (
    "contribution_id long, workspace_id long, subject_key string, run_id long, run_seq int, ingested_at timestamp, relative_path string, content_sha256 string, lines_of_code long, "
    "parse_status string, contribution_state string, analyzed_sha string, source_files_contribution long, detected_language string, callable_count long, nloc_status string"
)


@pytest.fixture
def write(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def ledger(*rows):
    """(run, path, digest, lines, callables, arrived, subject) -> whole rows."""
    return [(i, 1, s, 100 + r, r, at, p, h, n, f"parsed{n}", "in", "c", 1, "Go", k, "complete") for i, (r, p, h, n, k, at, s) in enumerate(rows)]


FILES = ledger(
    (1, "src/a.go", "0aB1", 5, 1, EARLY, "s"), (1, "src\\b.go", "b1", 7, 2, EARLY, "s"), (1, "Up.go", "c1", 1, 3, EARLY, "s"), (1, "up.go", "c2", 2, 4, EARLY, "s"),
    (1, "old.go", "dd", 3, 5, EARLY, "s"), (1, "fix.go", "ff", 90, 90, EARLY, "s"), (1, "./fix.go", "e1", 4, 6, LATE, "s"),
    (2, "./src//a.go", "sha256:ab1", 5, 1, EARLY, "s"), (2, "/src/b.go/", "B1", 7, 2, EARLY, "s"), (2, "Up.go", "c1", 1, 3, EARLY, "s"), (2, "up.go", "c2", 2, 4, EARLY, "s"),
    (2, "new.go", "DD", 3, 5, EARLY, "s"), (2, "fix.go", "e1", 4, 6, EARLY, "s"),
)


def test_one_file_however_spelled_and_the_last_delivery(spark, write):
    d = write("contributions", FILES, LEDGER)
    states = {r.path: r.state for r in E.Q["snapshot_diff"](spark, d).collect() if r.path}
    assert states == {"src/a.go": "unchanged", "src/b.go": "unchanged", "Up.go": "unchanged", "up.go": "unchanged", "fix.go": "unchanged", "old.go": "removed", "new.go": "added"}
    assert [(r.kind, r.old_path, r.new_path) for r in E.Q["exact_renames"](spark, d).collect()] == [("exact", "old.go", "new.go")]
    assert [(r.added, r.removed, r.changed, r.delta, r.outcome) for r in E.Q["delta_attribution"](spark, d).collect()] == [(3, 3, 0, 0, "exact_reconciliation")]
    assert E.Q["status_transitions"](spark, d).count() == 0
    hot = {r.path: (r.complexity, r.churn) for r in E.Q["attention_hotspots"](spark, d).collect()}
    assert hot == {"src/a.go": (1, 1), "src/b.go": (2, 1), "Up.go": (3, 1), "up.go": (4, 1), "old.go": (5, 1), "new.go": (5, 1), "fix.go": (6, 1)}


def test_only_what_was_replayed_leaves_the_rescue_column(spark):
    records = [
        '{"s": "x", "u": "y"}', '{"u": "y"}', '{"n": {"value": 5, "status": "partial"}}', '{"n": {"value": "+6"}}', '{"n": 7.5}', '{"n": 7.0, "m": 9}', '{"m": {"value": 1, "status": null}}', '{"n": true}',
        '{"b": "yes"}', '{"b": "True"}', '{"f": 9007199254740993}', '{"s": null, "u": null, "v": [1]}',
    ]
    target = {"n": "bigint", "s": "string", "b": "boolean", "f": "double"}
    df = spark.createDataFrame(list(enumerate(records)), "id int, j string")
    out = promote(ingest(df, "j", target, ["id"]).drop("_seen"), target, {"s": ["u"], "n": ["m"]}).orderBy("id").collect()
    assert [(r.n, r.s, r._rescued and json.loads(r._rescued)) for r in out[:8]] == [
        (None, "x", {"u": "y"}), (None, "y", None), (5, None, {"n": {"status": "partial"}}), (6, None, None), (None, None, {"n": 7.5}), (7, None, {"m": 9}), (1, None, {"m": {"status": None}}), (None, None, {"n": True}),
    ]
    assert [(r.b, r.f, r._rescued and json.loads(r._rescued)) for r in out[8:11]] == [(True, None, {"b": "yes"}), (True, None, None), (None, 9007199254740992.0, {"f": 9007199254740993})]
    assert json.loads(out[11]._rescued)["v"] == [1]


def test_spans_of_every_line(spark, write):
    lines = [(o, o * 7 % 40, o % 3, n, float(o * n % 11)) for o in range(40) for n in range(1, 8)]
    d = write("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    write("orders", [(o * 3, o) for o in range(60)], "o_orderkey long, o_custkey long")
    spans = [(s, o, p % 1000 + n, p % 1000 + n + int(q) % 7) for o, p, s, n, q in lines]
    islands = []
    for path, _, start, end in sorted(spans, key=lambda x: (x[0], x[2], x[3])):
        if islands and islands[-1][0] == path and start <= islands[-1][2] + 1:
            islands[-1][2:] = [max(islands[-1][2], end), islands[-1][3] + 1]
        else:
            islands.append([path, start, end, 1])
    assert sorted([r.path, r.start, r.end, r.spans] for r in E.Q["span_union"](spark, d).collect()) == islands
    partial = Counter(a[0] for a in spans for b in spans if a[0] == b[0] and a[2] < b[2] <= a[3] < b[3])
    assert {r.path: r.violations for r in E.Q["laminar_violations"](spark, d).collect()} == partial
    hunks = [(o % 100 + 1, o * 3 % 1000, o * 3 % 4) for o in range(60)]
    hits = [(k == 0, i) for path, i, start, end in spans for p, at, k in hunks if p == path and start <= at + max(k - 1, 0) and at <= end]
    got = {r.mode: (r.pairs, r.spans) for r in E.Q["hunk_overlap"](spark, d).collect()}
    assert got == {m: (sum(z == e for z, _ in hits), len({i for z, i in hits if z == e})) for m, e in (("zero_length_anchor", True), ("interval_intersection", False)) if any(z == e for z, _ in hits)}


def test_predicates_of_paths_with_backslashes(spark, write):
    d = write("contributions", ledger(*[(1, p, "a1", 1, 1, EARLY, "s") for p in ("src\\x.py", "v1.2\\Makefile", ".\\lib\\\\test_a.go", "src/x.py")]), LEDGER)
    got = {r.relative_path: (r.language, r.matched, r.portable) for r in E.Q["path_predicates"](spark, d).collect()}
    assert got == {"src\\x.py": ("Python", True, "src/x.py"), "v1.2\\Makefile": (None, False, "v1.2/Makefile"), ".\\lib\\\\test_a.go": ("Go", True, "lib/test_a.go"), "src/x.py": ("Python", True, "src/x.py")}


RUNS = ledger(
    (1, "a.go", "a1", 10, 1, EARLY, "s"), (1, "b.go", "b1", 10, 1, EARLY, "s"), (3, "a.go", "a2", 25, 1, EARLY, "s"), (3, "c.go", "b1", 10, 2, EARLY, "s"),
    (4, "a.go", "a2", 40, 1, EARLY, "s"), (4, "b.go", "b9", 10, 2, EARLY, "s"), (4, "c.go", "b1", 10, None, EARLY, "s"), (2, "z.go", "f1", 1, 1, EARLY, "t"), (4, "z.go", "f2", 1, 1, EARLY, "t"),
)


def test_every_run_against_the_one_before(spark, write):
    d = write("contributions", RUNS, LEDGER)
    diff = sorted((r.subject_key, r.run_id, r.path, r.state) for r in E.Q["snapshot_diff"](spark, d).collect())
    assert diff == [
        ("s", 103, "a.go", "changed"), ("s", 103, "b.go", "removed"), ("s", 103, "c.go", "added"),
        ("s", 104, "a.go", "unchanged"), ("s", 104, "b.go", "added"), ("s", 104, "c.go", "unchanged"), ("t", 104, "z.go", "changed"),
    ]
    assert [(r.run_id, r.kind, r.old_path, r.new_path) for r in E.Q["exact_renames"](spark, d).collect()] == [(103, "exact", "b.go", "c.go")]
    moved = sorted((r.subject_key, r.run_id, r.added, r.removed, r.changed, r.delta, r.outcome) for r in E.Q["delta_attribution"](spark, d).collect())
    assert moved == [("s", 103, 10, 10, 15, 15, "exact_reconciliation"), ("s", 104, 10, 0, 0, 25, "unexplained_residual"), ("t", 104, 0, 0, 0, 0, "exact_reconciliation")]
    changed = sorted((r.run_id, r.path, r.before, r.after) for r in E.Q["status_transitions"](spark, d).collect())
    assert changed == [(103, "a.go", "parsed10", "parsed25"), (104, "a.go", "parsed25", "parsed40")]
    by_language = sorted((r.subject_key, r.run_id, r.dimension, r.delta) for r in E.Q["language_deltas"](spark, d).collect())
    assert by_language == [("s", 103, "callable_count", 1.0), ("s", 103, "lines_of_code", 15.0), ("s", 104, "lines_of_code", 25.0)]
    judged = sorted((r.subject_key, r.run_id, r.baseline_run_id, r.delta, r.decision) for r in E.Q["ratchet_compare"](spark, d).collect())
    assert judged == [("s", 103, 101, 15.0, "tolerated"), ("s", 104, 101, 40.0, "regression"), ("s", 104, 103, 25.0, "regression"), ("t", 104, 102, 0.0, "unchanged")]


def test_every_version_step_and_every_year(spark, write):
    write("language_metrics", [(1, 10 + i, i, s, c) for i, (s, c) in enumerate([("1", "1"), ("2", "1"), ("2", "2"), ("2", "2")])], "workspace_id long, run_id long, run_seq int, artifact_schema_version string, metric_contract_version string")
    d = write("orders", [(dt.date(y, 5, 1), "1-URGENT", float(p)) for y, p in ((1992, 5), (1994, 7), (1995, 7), (1996, 9), (1998, 9))], "o_orderdate date, o_orderpriority string, o_totalprice double")
    assert sorted((r.run_id, r.verdict) for r in E.Q["comparability_verdict"](spark, d).collect()) == [(11, "qualified"), (12, "incomparable"), (13, "comparable")]
    assert sorted((r.year, r.dimension, r.delta) for r in E.Q["metric_deltas"](spark, d).collect()) == [(1994, "revenue", 2.0), (1996, "revenue", 2.0)]
