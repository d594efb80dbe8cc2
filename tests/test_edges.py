"""Nulls everywhere, empty tables and columns with clashing names: a defined result and no crash."""

import pytest
from pyspark.sql import functions as F

from sievework.operators import aggregates as A
from sievework.operators import binding as B
from sievework.operators import callables as L
from sievework.operators import clones as C
from sievework.operators import diff as D
from sievework.operators import extract as E
from sievework.operators import inputs as I
from sievework.operators import policy as P
from sievework.operators import projection as J
from sievework.operators import scope as K
from sievework.operators import spans as S
from sievework.sources import reports, strict_json, versions

ROW = "g string, v double, n int, text string, language string, path string, start int, end int, status string, value double, completeness string, field string, _text string, _range int, words string, id long, seq int, canonical_url string"
NULLS = (None,) * 18


def _rules(spark):
    return spark.createDataFrame([("r", "v", "gt", 1.0, "allowed", [], None, None)], "rule_id string, metric string, operator string, threshold double, partial_data string, languages array<string>, admit string, refuse string")


CASES = {
    "frequency": (lambda d: A.frequency(d, ["g"], "v"), 0), "structural_aggregate": (lambda d: A.structural_aggregate(d, ["g"], "v", F.col("n") > 0), 1), "distribution": (lambda d: A.distribution(d, ["g"], ["v", "value"]), 2),
    "sample_profile": (lambda d: A.sample_profile(d, ["g"], "v", {"p": 0.5}), 0), "poisoned": (lambda d: A.poisoned_totals(d, ["g"], ["n"]), 1), "label_counts": (lambda d: A.label_counts(d, ["g"], "status", ["a"]), None),
    "span_union": (lambda d: S.span_union(d, ["path"], "start", "end"), 0), "file_metrics": (lambda d: L.file_metrics(d, ["id"], "language", "text"), 0), "callables": (lambda d: L.callables(L.file_metrics(d, ["id"], "language", "text"), ["id"]), 0),
    "endpoints": (lambda d: E.endpoints(d, ["id"], "text", "language"), 0), "markers": (lambda d: E.markers(d, ["id"], "text", E.BROKERS), 0), "data": (lambda d: E.data_evidence(d, ["id"], "path", "text"), 1),
    "exclusion": (lambda d: d.select(K.exclusion_reason(F.col("path"), text=F.col("text"), git_mode=F.col("g"), symlink=F.lit(None).cast("boolean"))), 1), "nul": (lambda d: d.select(K.nul_class(F.col("text"))), 1), "scope": (lambda d: K.scope_hash(d, ["g"], ["path", "text"]), 1),
    "inputs": (lambda d: I.ledger(I.parse_rows(d, url="text", language="language", sha="g"), ["g"], ["n"], ["requested_sha"]), 0), "input_hash": (lambda d: I.input_hash(d, ["g"], "text"), 1),
    "observations": (lambda d: P.capture(P.observations(d, ["g"], {"v": F.col("v")}, F.col("completeness")), ["g"]), 0), "integrity": (lambda d: P.integrity(d, ["g"], {"x": F.col("n") > 0}), 1),
    "unit_findings": (lambda d: P.unit_findings(d, _rules(d.sparkSession), ["id"], ["v"], language="language", path="path"), 1), "bind": (lambda d: B.bind(d, d, ident="id", subject="g", revision="text", scope="path"), 1),
    "floors": (lambda d: C.body_floors(d, F.col("n"), F.col("n"), F.col("n")), 1), "groups": (lambda d: C.group_order(C.group_ids(d, ["g"], ["path"]), []), 1), "kinds": (lambda d: C.kind_status(d, ["g"], "status"), 1),
    "change_ids": (lambda d: D.change_ids(d, ["g"], "path", "text", "status"), 1), "catalogue": (lambda d: J.catalogue(d, ["g"], "language", ["v"], ["Go"]), 1), "semantic": (lambda d: J.semantic_hash(d, ["g"], ["path"], "text"), 1),
    "capped": (lambda d: J.capped(d, ["g"], [F.col("id")], "text"), 1), "family": (lambda d: J.family_status(F.col("text"), d, ["g"], "language", "n", "status"), 1), "explain": (lambda d: J.explain(d, ["g"], {"x": F.col("n") > 0}), 1), "python2": (lambda d: d.select(J.python2(F.col("text"))), 1),
    "json": (lambda d: strict_json.flatten(strict_json.checked(d, ["id"], "text"), ["id"]), 0), "tree": (lambda d: versions.tree_modes(d, ["id"], "text"), 0), "changes": (lambda d: versions.raw_changes(d, ["id"], "text"), 0), "worktree": (lambda d: versions.worktree(d, ["id"], "text"), 0),
    "markdown": (lambda d: reports.markdown_rows(d, ["text", "v"], ["id"]), 1), "html": (lambda d: reports.html_rows(d, ["text", "v"], ["id"]), 1), "sheet": (lambda d: reports.fact_sheet(d, ["id"], "text", ["v"]), 1),
}


@pytest.mark.parametrize("name", CASES)
def test_nulls_and_empty_tables(spark, name):
    f, rows = CASES[name]
    assert f(spark.createDataFrame([], ROW)).count() == 0
    out = f(spark.createDataFrame([NULLS], ROW)).collect()
    assert rows is None or len(out) == rows
    twice = f(spark.createDataFrame([NULLS, NULLS], ROW)).collect()
    assert len(twice) >= len(out)


def test_very_long_texts(spark):
    long = "def f(a):\n" + "    if a and a:\n        a = 'x#'\n" * 30_000
    deep = "class A { int f() { " + "if (a) { " * 400 + "}" * 400 + " } }"
    df = spark.createDataFrame([(1, "Python", long), (2, "Java", deep), (3, "Go", "x" * 1_000_000), (4, "JavaScript", "f(`${`" * 2000)], "id long, language string, text string")
    got = {r.id: r for r in L.file_metrics(df, ["id"], "language", "text").collect()}
    assert got[1].callables[0].decisions == 30_000 and got[1].code_lines == 60_001
    assert got[2].status in ("complete", "failed") and got[3].status == "complete" and got[4].status in ("complete", "failed")
