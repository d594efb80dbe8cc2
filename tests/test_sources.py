import json

import pytest
from pyspark.errors import PySparkException

from sievework.sources import readers, sinks
from sievework.streaming import runlog


def test_typed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,n,f,b,j\na,5,1.5,yes,"{""x"": null}"\nb, 5,nan,maybe,\n')
    columns = {"k": "string", "n": "integer", "f": "number", "b": "boolean", "j": "json"}
    df = readers.typed_csv(spark, str(tmp_path / "a.csv"), columns)
    assert [(r.k, r.n, r.f, r.b) for r in df.select("k", "n", "f", "b").collect()] == [("a", 5, 1.5, True), ("b", None, None, None)]
    assert {(r.k, r.column) for r in readers.violations(df, columns, ["k"]).collect()} == {("b", "n"), ("b", "f"), ("b", "b")}
    with pytest.raises(Exception, match="header"):
        readers.typed_csv(spark, str(tmp_path / "a.csv"), {"k": "string", "z": "string"}).collect()


def test_tree(spark, tmp_path):
    for name, text in (("src/a.py", "x = 1\n"), ("tests/b.py", "y"), ("c.bin", "\0"), ("vendor/d.go", "package d")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.relative_path: (r.language, r.exclusion_reason, r.included, r.source_text) for r in readers.source_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("Python", None, True, "x = 1\n"), "tests/b.py": ("Python", "test", False, None), "c.bin": (None, None, False, None), "vendor/d.go": ("Go", "vendor", False, None)}


def test_history(spark):
    text = "1\t2\ta.py\n-\t-\tb.bin\n3\t0\tsrc/{old => new}/c.py\n1\t1\tx.py => y.py\nnoise"
    got = [(r.added, r.deleted, r.path, r.old_path) for r in readers.numstat(spark.createDataFrame([("c1", text)], "c string, t string"), "c", "t").collect()]
    assert got == [(1, 2, "a.py", None), (None, None, "b.bin", None), (3, 0, "src/new/c.py", "src/old/c.py"), (1, 1, "y.py", "x.py")]
    patch = "@@ -1,2 +3 @@ f\n x\n@@ -9,0 +10,4 @@\n"
    got = [tuple(r)[1:] for r in readers.hunks(spark.createDataFrame([("p", patch)], "p string, t string"), ["p"], "t").collect()]
    assert got == [(0, 1, 2, 3, 1), (1, 9, 0, 10, 4)]


def test_run(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1), ("s", 2), ("t", None)], "subject string, v int")
    sinks.finalize_run(spark, str(tmp_path / "run"), {"rows": rows}, {"no negative": lambda t: t["rows"].where("v < 0")})
    assert readers.open_run(spark, str(tmp_path / "run"), ["rows"])["rows"].count() == 3
    with pytest.raises(ValueError):
        sinks.finalize_run(spark, str(tmp_path / "bad"), {"rows": rows}, {"no nulls": lambda t: t["rows"].where("v is null")})
    with pytest.raises(PySparkException):
        readers.open_run(spark, str(tmp_path / "bad"), ["rows"])
    sinks.write_ledger(rows, str(tmp_path / "ledger"), ["subject"])
    assert spark.read.parquet(str(tmp_path / "ledger")).where("subject = 's'").count() == 2
    assert [r.value for r in sinks.canonical_json(rows.where("v is null")).collect()] == ['{"subject":"t","v":null}']
    found = spark.createDataFrame([("r", "violation", "m", "a.py", 3)], "rule_id string, severity string, message string, path string, start_line int")
    result = json.loads(sinks.sarif_results(found).first().value)
    assert result["level"] == "error" and result["locations"][0]["physicalLocation"]["region"] == {"startLine": 3}


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"timestamp": "2025-01-01T00:01:00Z", "severity": s, "module": "m", "message": "x"} for s in ("info", "info", "error")]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = runlog.severity_counts(runlog.log_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.severity, r.n) for r in spark.sql("select * from counts").collect()} == {("info", 2), ("error", 1)}
