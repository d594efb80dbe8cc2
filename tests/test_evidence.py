import random
import textwrap

import pytest
from pyspark.sql import functions as F

from sievework.functions import numbers as N
from sievework.functions import status as S
from sievework.functions import text as X
from sievework.functions.paths import hex_number, portable_path
from sievework.operators import aggregates as A
from sievework.operators import callables as L
from sievework.operators import clones as C
from sievework.operators import diff as D
from sievework.operators import extract as E
from sievework.operators import hotspots as H
from sievework.operators import policy as P
from sievework.operators import scope as K
from sievework.operators import spans as R
from sievework.plans.evidence_queries import clone_suppression


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


def test_unavailable_is_never_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2), ("b", None)], "g string, v long")
    assert rows(A.nothing_measured(df, ["g"], "v"), "g", "measured", "total", "max") == [("a", None, None, None), ("b", 1, 2, 2)]
    assert rows(A.poisoned_totals(df, ["g"], ["v"]), "g", "v") == [("a", None), ("b", None)]
    assert rows(A.structural_aggregate(df, ["g"], "v", F.lit(True)), "g", "n", "evaluable", "total", "median") == [("a", 2, 0, None, None), ("b", 2, 1, 2, 2)]
    assert A.distribution(df.where("false"), ["g"], ["v"]).count() == 0


def test_percentiles_are_nearest_rank(spark):
    random.seed(2)
    values = sorted(random.randrange(50) for _ in range(37))
    got = A.distribution(spark.createDataFrame([(v,) for v in values], "v long"), [], ["v"]).first()
    for p in A.POSITIONS:
        assert got[f"p{p}"] == values[max(1, -(-p * 37 // 100)) - 1]


def test_rollup_and_primary_language(spark):
    df = spark.createDataFrame([("s", "Go", 5), ("s", "Java", 5), ("s", "Go", None), ("t", "Go", None)], "s string, lang string, loc long")
    assert rows(A.component_rollup(df, ["s"], "lang", ["loc"]), "s", "lang", "loc") == sorted([("s", "Go", 5), ("s", "Java", 5), ("s", None, 10), ("t", "Go", None), ("t", None, None)], key=repr)
    sums = df.groupBy("s", "lang").agg(F.sum("loc").alias("loc"), F.lit(1).alias("n"))
    assert rows(A.primary_language(sums, ["s"], "lang", "loc", "n", ("Java", "Go")), "s", "primary_language", "tied") == [("s", "Java", True), ("t", "Go", False)]


def test_statuses(spark):
    df = spark.createDataFrame([("a", "failed"), ("a", "failed"), ("b", "failed"), ("b", "complete"), ("c", None)], "g string, s string")
    assert rows(A.status_rollup(df, ["g"], ["s"]), "g", "s") == [("a", "failed"), ("b", "partial"), ("c", "not_applicable")]
    assert one(spark, "complete", lambda c: S.degrade(c, F.lit("partial"))) == "partial"
    assert one(spark, "x", lambda c: S.worst(F.lit("complete"), F.lit("failed"), F.lit(None).cast("string"))) == "failed"


def test_reconcile(spark):
    recorded = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 1)], "k long, v long").withColumn("status", F.lit("complete"))
    parts = spark.createDataFrame([(1, 2), (1, 3), (2, 5), (2, None), (3, 1)], "k long, v long")
    assert rows(A.reconcile(recorded, parts, ["k"], ["v"], "status"), "k", "parts", "skipped", "residual", "outcome") == [(1, 5, 0, 0, "exact"), (2, 5, 1, 1, "residual"), (3, 1, 0, None, "not_evaluable"), (4, None, None, None, "not_evaluable")]


def test_profile_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4, 5, 6)], "v double")
    got = A.sample_profile(df, [], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (got.median, got.p50, got.p90) == (3.5, 3.0, 5.0)


def test_signals(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 1, 2, 3, None)] + [("b", 7)], "g string, v long")
    assert rows(H.rank_signal(df, "v", ["g"], "s"), "g", "v", "s") == sorted([("a", 1, "low"), ("a", 1, "low"), ("a", 2, "medium"), ("a", 3, "high"), ("a", None, None), ("b", 7, "medium")], key=repr)


def test_lineage(spark):
    history = spark.createDataFrame([("s", 1, "a", 1, 1), ("s", 2, "b", 2, 0), ("s", 3, "c", 1, 0), ("s", 3, "x", None, None), ("s", 4, "x", 5, 5), ("s", 4, "a", 9, 0)], "s string, seq int, path string, added int, deleted int")
    renames = spark.createDataFrame([("s", 2, "a", "b"), ("s", 3, "b", "c")], "s string, seq int, old string, new string")
    assert rows(H.lineage_churn(history, renames, ["s"]), "path", "commits", "touched") == [("a", 1, 9), ("c", 3, 5), ("x", 2, None)]
    assert rows(H.lineage_churn(history, renames.where("false"), ["s"]), "path", "commits") == [("a", 2), ("b", 1), ("c", 1), ("x", 2)]


def test_spans(spark):
    df = spark.createDataFrame([("p", 1, 3), ("p", 4, 6), ("p", 9, 9), ("p", 5, 4), ("q", 1, None)], "path string, s long, e long")
    assert rows(R.span_union(df, ["path"], "s", "e"), "start", "end", "spans") == [(1, 6, 2), (9, 9, 1)]
    random.seed(5)
    spans = [(i, s, s + random.randrange(90)) for i, s in enumerate(random.randrange(300) for _ in range(120))]
    got = R.laminar_violations(spark.createDataFrame([("p", *x) for x in spans], "path string, id long, s long, e long"), ["path"], "id", "s", "e", block=16)
    assert rows(got, "a", "b") == sorted(((a, b) for a, s, e in spans for b, t, f in spans if s < t <= e < f), key=repr)
    hunks = spark.createDataFrame([("p", 10, 0), ("p", 12, 3)], "path string, at long, count long")
    calls = spark.createDataFrame([("p", "f", 1, 10), ("p", "g", 11, 12), ("p", "h", 15, 20)], "path string, name string, start long, end long")
    assert rows(R.hunk_overlap(calls, hunks, ["path"], block=4), "name", "at", "mode") == [("f", 10, "zero_length_anchor"), ("g", 12, "interval_intersection")]


def test_diff(spark):
    left = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "9"), ("e", "8"), ("f", "8")], "path string, h string")
    right = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "1"), ("x", "9"), ("y", "8")], "path string, h string")
    evidence = D.file_evidence(left, right, ["path"], "h")
    assert dict(rows(evidence, "path", "state")) == {"a": "unchanged", "b": "changed", "c": "indeterminate", "d": "removed", "e": "removed", "f": "removed", "x": "added", "y": "added"}
    assert rows(D.exact_renames(evidence, [], "path"), "digest", "kind", "old_path", "new_path") == [("8", "ambiguous", None, None), ("9", "exact", "d", "x")]
    a = spark.createDataFrame([("k", 1), ("m", None), ("z", 2)], "k string, v long")
    b = spark.createDataFrame([("k", 4), ("m", 1), ("z", 2)], "k string, v long")
    assert rows(D.deltas(a, b, ["k"], ["v"]), "k", "delta", "reason") == [("k", 3.0, None), ("m", None, "measurement_unavailable")]


def test_clones(spark):
    df = spark.createDataFrame([("en", "p", "a  b\r\nc"), ("en", "q", "a b c"), ("en", "p", "a b c"), ("fr", "p", "a b c"), ("en", "p", None), ("en", "p", " ")], "lang string, path string, text string")
    assert rows(C.group_clones(df, "lang", "path", C.canonical_text(F.col("text"))), "language", "occurrences", "paths", "distribution") == [("en", 3, 2, "mixed")]
    for language, text in (("Python", "def f(x):\n    {}\n"), ("JavaScript", "function f(x) {{ {} }}"), ("Go", "func f(x int) {{ {} }}")):
        forms = [L.facts(text.format(body), language)["callables"][0] for body in ("x = y + 1; x = 'a'", "q = r + 20; q = 'bb'", "x = x + 1; x = 'a'", "x = y + 1;  x = 'a'")]
        a, b, c, d = [f["structural"] for f in forms]
        assert a == b == d != c and forms[0]["lexical"] == forms[3]["lexical"] != forms[1]["lexical"]


def test_suppression(spark):
    schema = "grp string, kind string, path string, start long, end long"
    big = [("P", "k", f, 1, 20) for f in "ab"]
    small = [("C", "k", f, 5, 9) for f in "ab"]
    other = [("O", "k", "a", 3, 4), ("O", "k", "z", 3, 4)]
    assert rows(C.suppress_dominated(spark.createDataFrame(big + small + other, schema)), "child", "parent") == [("C", "P")]
    twice = [("P", "k", "a", 1, 20), ("P", "k", "a", 2, 18), ("C", "k", "a", 5, 9), ("C", "k", "a", 3, 4)]
    assert rows(C.suppress_dominated(spark.createDataFrame(twice, schema)), "child", "parent") == [("C", "P")]
    short = [("P", "k", "a", 1, 9), ("P", "k", "a", 30, 40), ("C", "k", "a", 2, 3), ("C", "k", "a", 5, 6)]
    assert rows(C.suppress_dominated(spark.createDataFrame(short, schema)), "child", "parent") == []


def test_suppression_broadcasts_nothing_by_estimate(spark, tmp_path):
    """Keys of parts take a byte or two in the file, the spans made of them some hundred times that."""
    spark.range(2000).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = clone_suppression(spark, str(tmp_path))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "child", "parent") == sorted(((f"C{i}", f"P{i}") for i in range(2000) if i % 4 in (0, 3)), key=repr)


def test_scope(spark):
    df = spark.createDataFrame([("g", f"p{i}", str(i)) for i in range(500)], "g string, path string, h string")
    a = K.scope_hash(df, ["g"], ["path", "h"]).first()
    b = K.scope_hash(df.repartition(7).orderBy(F.rand(3)), ["g"], ["path", "h"]).first()
    assert a.scope_hash == b.scope_hash and a.files == 500
    assert a.scope_hash != K.scope_hash(df.where("path <> 'p3'"), ["g"], ["path", "h"]).first().scope_hash
    for path, reason in (("src/a.py", None), ("src/a.pyi", "declaration_only"), ("tests/a.py", "test"), ("x/vendor/a.js", "vendor"), ("dist/a.js", "build_output"), ("a.min.js", "minified_or_bundled"), ("x_test.go", "test")):
        assert one(spark, path, K.exclusion_reason) == reason, path
    for text, kind in (("a\nb", "lf"), ("a\r\nb", "crlf"), ("a\rb", "cr"), ("a\nb\r\n", "mixed"), ("a", "none")):
        assert one(spark, text, K.line_endings) == kind


def test_markers(spark):
    text = "app.get('/a', f); @PostMapping(\"/b\")\nhttp.HandleFunc(\"/c\", h)\n@bp.route('/d')\nuses Kafka"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    each = df.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in ("JavaScript", "Java", "Go")])))
    assert rows(E.endpoints(each, ["id", "lang"], "text", "lang"), "lang", "method", "route") == [("Go", "ANY", "/c"), ("Go", "ANY", "/d"), ("Go", "GET", "/a"), ("Java", "POST", "/b"), ("JavaScript", "ANY", "/c"), ("JavaScript", "ANY", "/d"), ("JavaScript", "GET", "/a")]
    assert rows(E.markers(df, ["id"], "text", E.BROKERS), "id", "marker", "matched") == [(1, "kafka", "Kafka")]


def test_policy(spark):
    rules = spark.createDataFrame([("r", "m", "gt", 5.0, "not_evaluable")], "rule_id string, metric string, operator string, threshold double, partial_data string")
    states = [("a", 6.0, "complete"), ("b", 5.0, "complete"), ("c", 9.0, "partial"), ("d", None, "complete"), ("e", None, None), ("f", None, "not_applicable")]
    observed = spark.createDataFrame([(s, "m", v, c) for s, v, c in states], "s string, metric string, value double, completeness string")
    found = P.judge(observed, rules, ["s"])
    assert rows(found, "s", "status", "reason") == [
        ("a", "violated", None), ("b", "passed", None), ("c", "not_evaluable", "partial_data_refused"), ("d", "not_evaluable", "measurement_unavailable"),
        ("e", "not_evaluable", "measurement_absent"), ("f", "not_applicable", None),
    ]
    assert P.tallies(found).first().asDict() == {"rule_id": "r", "violated": 1, "passed": 1, "not_evaluable": 3, "not_applicable": 1, "evaluation_error": 0}
    base = spark.createDataFrame([(k, 10.0) for k in "abcdef"], "k string, value double")
    now = spark.createDataFrame([("a", 10.0, "complete"), ("b", 9.0, "complete"), ("c", 11.0, "complete"), ("d", 20.0, "complete"), ("e", 1.0, "partial"), ("z", 1.0, "complete")], "k string, value double, completeness string")
    assert dict(rows(P.ratchet(base, now, ["k"], allowed=2.0), "k", "decision")) == {"a": "unchanged", "b": "improved", "c": "tolerated", "d": "regression", "e": "partial", "f": "missing", "z": "extra"}


SOURCE = '''
def f(a, *b, c=1, **d):
    if a and b or c:
        for x in b:
            if x:
                return f(x)
    elif c:
        return [y for y in b if y]
    else:
        pass

class K:
    def m(self):
        try:
            while True:
                pass
        except (A, B):
            return 1 if self else 2
'''


def test_callables():
    f, m = L.facts(textwrap.dedent(SOURCE), "Python")["callables"]
    assert (f["qualified_name"], f["parameters"], f["cyclomatic"], f["max_nesting"]) == ("f", 4, 1 + 1 + 2 + 1 + 1 + 1 + 2, 3)
    assert f["cognitive"] == 1 + 2 + 2 + 3 + 1 + 2 + 1 + 1 + 1
    assert (m["qualified_name"], m["kind"], m["cyclomatic"], m["max_nesting"], m["cognitive"]) == ("K.m", "class_method", 4, 2, 1 + 1 + 2)
    assert L.facts("def f(:", "Python") is None and L.facts("", "Python")["callables"] == []


@pytest.mark.parametrize(
    "body,want",
    [
        ("return [a for a in x if a]", {"cognitive": 2, "cyclomatic": 3}), ("if a:\n        b\n    else:\n        if c:\n            d", {"max_nesting": 2, "cognitive": 4}),
        ("match a:\n        case x:\n            pass", {"cyclomatic": 2}), ("match a:\n        case _:\n            pass", {"cyclomatic": 1}), ("match a:\n        case 1 if b:\n            pass", {"cognitive": 2}),
        ("return a or b and c or d", {"cognitive": 3}), ("x = 1\x0c\n    y = 2", {"nloc": 3}), ("x = \"\"\"\n# in a text\n\"\"\"", {"nloc": 4}), ("with a:\n        b", {"max_nesting": 1, "cognitive": 0}),
    ],
)
def test_python_measures(body, want):
    (c,) = L.facts(f"def f(x):\n    {body}\n", "Python")["callables"]
    assert {k: c[k] for k in want} == want


@pytest.mark.parametrize(
    "language,text,name,want",
    [
        ("Java", "class A { A(int a) {} abstract int s(); int f(Map<K, V> m, int... b) { for (;;) { if (a && b || c) f(m); else if (d) g(); else h(); } } }", "A.f", {"parameters": 2, "decisions": 3, "booleans": 2, "cognitive": 1 + 2 + 2 + 1 + 1 + 1, "max_nesting": 2}),
        ("Java", "class A { int f() { switch (k) { case 1: case 2: a(); default: b(); } Runnable r = () -> { if (z) q(); }; return x ? 1 : y ? 2 : 3; } }", "A.f", {"decisions": 4, "cognitive": 1 + 1 + 2, "max_nesting": 2}),
        ("JavaScript", "export const f = async (a) => { try { await a } catch { b() } finally { c() } }\nconst re = /[{(]/\n", "f", {"decisions": 1, "cognitive": 1, "max_nesting": 1}),
        ("JavaScript", "const f = x => x ?? y\nconst g = 1", "f", {"booleans": 1, "parameters": 1, "end_line": 1}),
        ("TypeScript", "function f(a: string): void;\nfunction f(a?: any): a is B { return a ? true : false }", "f", {"decisions": 1, "parameters": 1}),
        ("Go", "package p\nfunc (s *S) f(a, b int) error {\n\tif err := s.f(1, 2); err != nil && ok {\n\t\treturn err\n\t} else {\n\t\tgoto end\n\t}\n\tgo func() { if x { } }()\n}", "S.f", {"decisions": 1, "booleans": 1, "cognitive": 1 + 1 + 1 + 1 + 1, "parameters": 2}),
    ],
)
def test_measures_of_braced_languages(language, text, name, want):
    c = next(c for c in L.facts(text, language)["callables"] if c["qualified_name"] == name)
    assert {k: c[k] for k in want} == want


def test_whole_declarations_before_a_fault(spark):
    text = "package a\nfunc f(x int) { if x > 0 { g() } }\nfunc h() { if (\n// end"
    df = spark.createDataFrame([(1, "Go", text), (2, "Java", "class A { void f() {} }\n}"), (3, "JavaScript", "(")], "id long, lang string, text string")
    got = {r.id: r for r in L.file_metrics(df, ["id"], "lang", "text").collect()}
    assert (got[1].status, got[1].recovery, got[1].methods_functions, got[1].code_lines, got[1].comment_lines) == ("partial", "sound_prefix", 1, 3, 1)
    assert (got[2].status, got[2].classes_structs) == ("partial", 1) and (got[3].status, got[3].recovery, got[3].code_lines) == ("failed", None, None)


def test_what_cannot_be_read_is_not_zero(spark):
    df = spark.createDataFrame([(1, "Go", "package a {"), (2, "Python", "x ="), (3, "Python", "x = 1"), (4, None, None), (5, "Cobol", "x"), (6, "Java", "")], "id long, lang string, text string")
    assert rows(L.file_metrics(df, ["id"], "lang", "text"), "id", "status", "code_lines", "methods_functions") == [(1, "failed", None, None), (2, "failed", None, None), (3, "complete", 1, 0), (5, "not_applicable", None, None), (6, "complete", 0, 0)]


@pytest.mark.parametrize(
    "f,text,want",
    [
        (N.numeric_value, " 1.5 ", 1.5), (N.numeric_value, "true", None), (N.numeric_value, "NaN", None), (N.numeric_value, "", None), (N.numeric_value, "1e999", None),
        (N.strict_integer, "+7", 7), (N.strict_integer, " 7", None), (N.strict_integer, "1_0", None), (N.lenient_boolean, " Yes", True), (N.lenient_boolean, "2", None),
        (portable_path, ".\\a//b/./c/", "a/b/c"), (portable_path, "a/b", "a/b"), (lambda c: F.hex(hex_number(c)), "sha256:00Ab", "AB"), (hex_number, "zz", None),
        (X.subject_of_url, "https://h.example/Own/n.git", "repo:Own/n"), (X.escape_html, "<a&'>", "&lt;a&amp;&#x27;&gt;"), (lambda c: X.join_routes(F.lit("/a/"), c), "/b", "/a/b"),
        (lambda c: X.glob(c, "src/*.py"), "src/x/y.py", True), (lambda c: F.hex(X.frame(c)), "é", "0000000000000002C3A9"), (X.visible_text, "a\x07b", "a�b"),
    ],
)
def test_scalars(spark, f, text, want):
    assert one(spark, text, f) == want
