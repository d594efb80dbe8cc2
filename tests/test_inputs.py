"""The input ledger, version-control listings, strict JSON, binding and reports on small tables."""

from sievework.operators import aggregates as A
from sievework.operators import binding as B
from sievework.operators import diff as D
from sievework.operators import inputs as I
from sievework.operators import policy as P
from sievework.operators import scope as K
from sievework.operators import snapshots
from sievework.sources import reports, sinks, strict_json, versions

import datetime as dt

import pytest
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_ledger(spark):
    schema = "ws long, line int, url string, lang string, sha string, enabled string, ledger string"
    given = [
        (1, 1, "https://git.example.org/a/b.git", "python", "ABCDEF1", "", "x"), (1, 2, "git@GIT.example.org:a/b", "Python", "abcdef1 ", "no", "x"), (1, 3, "https://git.example.org/a/c", None, None, "no", "x"),
        (1, 4, "https://git.example.org/d/e", "go", None, None, "x"), (1, 5, "https://git.example.org/D/E", "java", None, None, "x"), (1, 6, None, "go", None, None, "x"), (1, 7, "nonsense", "cobol", "xyz", "perhaps", "x"),
    ]
    parsed = I.parse_rows(spark.createDataFrame(given, schema), url="url", language="lang", sha="sha", enabled="enabled")
    assert [(r.line, r.problems) for r in parsed.where(F.size("problems") > 0).orderBy("line").collect()] == [(6, ["missing_url"]), (7, ["wrong_url", "unknown_language", "wrong_sha", "wrong_flag"])]
    kept = I.ledger(parsed, ["ws"], ["line"], ["requested_sha", "expected_language"])
    assert rows(kept, "line", "duplicate", "representative_row", "disposition") == [
        (1, "representative", None, "pending"), (2, "identical", 1, "skipped_duplicate"), (3, "unique", None, "skipped_disabled"), (4, "representative", None, "refused_conflict"), (5, "identical", 4, "refused_conflict"),
    ]
    outcomes = spark.createDataFrame([(1, "https://git.example.org/a/b", None, "abcdef1", "verified", "complete")], "ws long, canonical_url string, resolved_sha string, analyzed_sha string, verification string, status string")
    done = I.apply_outcomes(kept, outcomes, ["ws"])
    assert rows(I.frozen_rows(done), "line", "commit_sha") == [(1, "abcdef1")] == rows(I.retry_rows(done), "line", "commit_sha")
    assert I.ledger(parsed.where("false"), ["ws"], ["line"], ["requested_sha"]).count() == 0
    a = I.input_hash(spark.createDataFrame([(1, "b"), (1, "a")], "g int, h string"), ["g"], "h").first()
    assert a.input_hash == I.input_hash(spark.createDataFrame([(1, "a"), (1, "b")], "g int, h string"), ["g"], "h").first().input_hash and a.files == 2


def test_listings(spark):
    text = "100644 blob " + "a" * 40 + "\tx\\y.py\n160000 commit " + "b" * 40 + "\tm\nnoise"
    assert rows(versions.tree_modes(spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string"), ["i"], "t"), "i", "kind", "path") == [(1, "regular", "x/y.py"), (1, "submodule", "m")]
    moved = spark.createDataFrame([(1, "removed", "o", "a", None, None), (1, "added", None, None, "o", "b"), (1, "removed", "p", "c", None, None), (1, "removed", "p", "d", None, None), (1, "added", None, None, "p", "e")], "s int, change string, old_object string, old_path string, new_object string, new_path string")
    assert rows(versions.unique_renames(moved, ["s"]), "object", "old_path", "new_path") == [("o", "a", "b")]
    for path, inside in (("a/../b", True), ("../a", False), ("a/../../b", False), ("/a", False), ("C:\\a", False)):
        assert spark.createDataFrame([(path,)], "p string").select(versions.contained(F.col("p"))).first()[0] is inside, path


def test_strict_json(spark):
    texts = ['{"a": 1, "b": {"a": [1, {}]}}', '{"a": 1, "a": 1}', "NaN", "[[[[[1]]]]]", "", None, "{", "[1e999]", '"x"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = strict_json.checked(df, ["i"], "t", most_depth=4, most_items=20)
    assert [r.fault for r in found.orderBy("i").collect()] == [None, "repeated_key:a", "not_finite:NaN", "too_deep", "malformed", "missing", "malformed", "not_finite:number", None]
    leaves = strict_json.flatten(found, ["i"])
    assert rows(leaves.where("i = 0"), "pointer", "kind", "value") == [("/a", "integer", "1"), ("/b/a/0", "integer", "1"), ("/b/a/1", "object", "{}")]
    assert strict_json.structural_difference(leaves, leaves, ["i"]).count() == 0


def test_binding(spark):
    subjects = spark.createDataFrame([("s", "r1", "h1"), ("s", "r1", "h1"), ("t", "r1", "h2"), ("u", "r2", None), ("v", "r3", "h"), ("w", "r3", "h"), ("x", None, "h")], "subject string, revision string, scope string")
    evidence = spark.createDataFrame([(1, "r1", "h1"), (2, "r2", "h"), (3, "r3", "h"), (4, None, "h"), (5, "r9", "h"), (6, "r1", None)], "id int, revision string, scope string")
    bind = lambda strict: rows(B.bind(evidence, subjects, ident="id", subject="subject", revision="revision", scope="scope", strict=strict), "id", "decision", "subject", "compared")
    assert bind(True) == [(1, "bound", "s", True), (2, "refused_other_scope", None, None), (3, "refused_ambiguous", None, None), (4, "refused_no_revision", None, None), (5, "refused_unknown_revision", None, None), (6, "refused_other_scope", None, None)]
    assert bind(False)[1] == (2, "bound", "u", False) and bind(False)[5][1] == "refused_ambiguous"
    one = spark.createDataFrame([("p", "f", 1), ("p", "g", 5), ("p", "h", 1), ("p", "h", 9)], "path string, name string, start_line int")
    two = spark.createDataFrame([("p", "f", 1), ("p", "g", 6), ("p", "h", 2), ("p", "k", 3)], "path string, name string, start_line int")
    assert rows(B.match_callables(one, two, ["path"], "name"), "name", "left_start", "right_start", "stage") == [("f", 1, 1, "exact"), ("g", 5, 6, "name"), ("h", 1, None, "left_only"), ("h", 9, None, "left_only"), ("h", None, 2, "right_only"), ("k", None, 3, "right_only")]


def test_reports_and_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b<c>", 0, None)], "i int, s string, n int, m double")
    assert reports.markdown_rows(df, ["s", "n", "m"], ["i"]).first().line == "| a\\|b\\<c\\> | 0 | unavailable |"
    assert reports.html_rows(df, ["s", "m"], ["i"]).first().line == "<tr><td>a|b&lt;c&gt;</td><td>unavailable</td></tr>"
    assert sinks.write_laid_out(df, str(tmp_path / "one"), ["i"]) == "single"
    assert sinks.write_laid_out(spark.range(50_001).withColumn("k", F.col("id") % 3), str(tmp_path / "many"), ["k"]) == "partitioned" and spark.read.parquet(str(tmp_path / "many")).count() == 50_001
    assert sinks.schema_violations(df, {"i": "int", "s": "int", "z": "int"}, ["z"]) == ["missing:z", "required:z", "type:s", "unknown:m", "unknown:n"]
    assert rows(sinks.required_violations(df, ["i"], ["s", "m"]), "i", "field") == [(1, "m")]


def test_waivers_in_the_order_they_were_written(spark):
    found = spark.createDataFrame([("r", "s", "violated"), ("r", "t", "violated"), ("r", "s", "passed")], "rule_id string, subject string, status string")
    waivers = spark.createDataFrame([(1, "z", "r", "s", None), (2, "a", "r", None, None), (0, "old", "r", None, dt.date(2020, 1, 1))], "place int, waiver_id string, rule_id string, subject string, expires_on date")
    assert rows(P.waive(found, waivers, "subject", F.lit(dt.date(2025, 1, 1))), "subject", "status", "waiver_id") == [("s", "passed", None), ("s", "violated", "z"), ("t", "violated", "a")]
    with pytest.raises(ValueError):
        P.authored(spark.range(P.AUTHORED + 1))


def test_content_reasons(spark):
    def reason(path, text, mode="100644"):
        return spark.createDataFrame([(path, text, mode)], "p string, t string, m string").select(K.exclusion_reason(F.col("p"), text=F.col("t"), git_mode=F.col("m"))).first()[0]

    assert reason("a.go", "// Code generated by x. DO NOT EDIT.\npackage a") == "generated" and reason("a.go", "package a\n// Code generated by x. DO NOT EDIT.") is None
    assert reason("a.js", "x", "120000") == "git_symlink" and reason("tests/a.js", "x", "160000") == "git_submodule"
    assert reason("src/components/vendors/a.ts", "x") is None and reason("lib/vendors/a.ts", "x") == "vendor" and reason("node_modules/a/b.js", None) == "dependency"
    assert reason("a.ts", '<?xml version="1.0"?><TS version="2">') == "content_type_mismatch" and reason("a.ts", "[[${x}]]") == "templated_source"
    assert reason("a/b.py", None) is None and reason("jest.config.ts", "") == "test" and reason(".idea/a.py", "") == "excluded_directory"


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_sums_over_ranges(spark, ranges):
    values = [(g, v if v % 5 else None, 1 + v % 3) for g in ("a", None) for v in range(40)]
    df = spark.createDataFrame(values, "g string, v int, n int").repartition(ranges)
    want = {}
    for g in ("a", None):
        total = 0
        for _, v, n in sorted((x for x in values if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0)):
            total += n
            want[g, v] = max(total, want.get((g, v), 0))
    got = A.running(df.groupBy("g", "v").agg(F.sum("n").alias("n")), ["g"], "v", "n", "upto").collect()
    assert {(r.g, r.v): r.upto for r in got} == want and {r.upto_all for r in got} == {sum(x[2] for x in values) // 2}


@pytest.mark.parametrize("limit", [-1, 200_000])
def test_snapshots_by_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr(snapshots, "BROADCAST_SNAPSHOTS", limit)
    at = dt.datetime(2025, 1, 1)
    given = [(1, "s", 10 + r, r, f"f{i}", f"{i + (r == 3 and i == 2):x}", at) for r in (1, 2, 3) for i in range(1, 6) if (r, i) not in ((2, 4), (3, 5))]
    df = spark.createDataFrame(given, "w long, s string, run long, seq int, path string, h string, at timestamp")
    out = snapshots.snapshot_changes(df, group=["w", "s"], run="run", sequence="seq", path="path", digest="h", arrived="at")
    assert rows(out, "run", "path", "change_kind") == [(12, "f4", "removed"), (13, "f2", "changed"), (13, "f4", "added"), (13, "f5", "removed")]


def test_change_ids_and_admission(spark):
    changes = spark.createDataFrame([("s", None, "b", "added"), ("s", "a", None, "removed"), ("s", "c", "c", "changed")], "s string, o string, n string, k string")
    got = D.change_ids(changes, ["s"], "o", "n", "k")
    assert rows(got, "place", "k") == [(1, "removed"), (2, "changed"), (3, "added")] and got.select("change_id").distinct().count() == 3
    base, now = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, c string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, c string")
    assert rows(P.admission(base, now, ["k"], ["c"]), "k", "decision") == [("a", "admitted"), ("b", "incompatible:c"), ("d", "no_baseline")]
