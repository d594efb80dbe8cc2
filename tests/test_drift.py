import datetime as dt
import json

from pyspark.sql import functions as F

from sievework.operators.drift import ingest, promote, schema_changes, with_header

T = dt.datetime(2025, 1, 1)
TARGET = {"n": "bigint", "s": "string", "f": "double", "b": "boolean", "l": "array<string>"}
KEEP = ["ws", "run", "rec", "at"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "ws long, run long, seq int, rec string, at timestamp, j string, field string")


def changes(spark, rows):
    df = frame(spark, rows)
    out = schema_changes(df, stream=["ws"], run="run", sequence="seq", record="rec", arrived="at", body="j").collect()
    return sorted((r.run, r.old_field, r.new_field, r.change_kind) for r in out)


def test_nothing_is_lost(spark):
    records = ['{"n": 5, "s": "x", "f": 0.5, "b": true, "l": ["a"], "u": {"k": [1, null]}}', '{"n": "7", "s": null, "l": [1], "f": 2}', "broken {", None, "[1]", '{"n": 99999999999999999999}', ""]
    rows = frame(spark, [(1, 1, 1, str(i), T, j) for i, j in enumerate(records)])
    got = {r.rec: r for r in ingest(rows, "j", TARGET, KEEP).collect()}
    assert (got["0"].n, got["0"].s, got["0"].f, got["0"].b, got["0"].l) == (5, "x", 0.5, True, ["a"])
    assert json.loads(got["0"]._rescued) == {"u": {"k": [1, None]}}
    assert got["1"].n is None and json.loads(got["1"]._rescued) == {"n": "7", "l": [1], "f": 2}
    assert json.loads(got["2"]._rescued) == {"_corrupt": "broken {"} and got["3"]._rescued is None
    assert json.loads(got["4"]._rescued) == {"_corrupt": "[1]"} and json.loads(got["5"]._rescued) == {"n": 99999999999999999999}
    out = {r.rec: r for r in promote(ingest(rows, "j", TARGET, KEEP).drop("_seen"), TARGET, {"s": ["u"]}).collect()}
    assert (out["1"].n, out["1"].f, out["1"].l, out["1"]._rescued) == (7, 2.0, ["1"], None)
    assert json.loads(out["2"]._rescued) == {"_corrupt": "broken {"}


def test_changes(spark):
    rows = [
        (1, 1, 1, "a", T, '{"n": 1, "old": "q", "gone": 1, "t": 1}'), (1, 1, 1, "b", T, '{"n": null, "old": "r", "t": 2}'), (1, 1, 1, None, T, '{"n": 3, "old": "z"}'),
        (1, 2, 2, "a", T, '{"n": 1, "new": "q", "came": 2, "t": "1"}'), (1, 2, 2, "b", T, '{"new": "r", "t": "2"}'), (1, 2, 2, "b", T, '{"new": "r", "t": "2"}'),
        (1, 3, 3, "c", T, '{"n": 1.5, "newer": "q", "came": 2, "t": null}'),
        (2, 9, 1, "a", T, '{"only": 1}'),
    ]
    assert changes(spark, rows) == [
        (2, "", "came", "added"), (2, "gone", "", "removed"), (2, "old", "new", "renamed"), (2, "t", "t", "type_changed"),
        (3, "", "newer", "added"), (3, "n", "n", "type_changed"), (3, "new", "", "removed"),
    ]


def test_ambiguous_renaming_uses_each_field_once(spark):
    rows = [(1, 1, 1, "a", T, '{"p": 1, "q": 1}'), (1, 2, 2, "a", T, '{"x": 1, "y": 1, "z": 1}')]
    assert changes(spark, rows) == [(2, "", "z", "added"), (2, "p", "x", "renamed"), (2, "q", "y", "renamed")]


def test_empty(spark):
    assert changes(spark, []) == []


def test_header(spark):
    rows = [(1, 1, 0, None, T, "﻿ID ", " Name", ""), (1, 1, 0, None, T, "﻿ID ", " Name", ""), (1, 1, 1, "e", T, "5", "", "spare"), (1, 2, 1, "e", T, "5", "", "")]
    df = spark.createDataFrame(rows, "ws long, run long, line int, rec string, at timestamp, c0 string, c1 string, c2 string")
    out = with_header(df, ["c0", "c1", "c2"], stream=["ws"], run="run", line="line", arrived="at", record="rec", rest=[])
    lines = [json.loads(r.record_json) for r in out.where(F.col("record_json").isNotNull()).collect()]
    assert lines == [{"id": "5", "name": None, "_cell_2": "spare"}]
    assert out.where("header is not null").select("header").distinct().collect()[0].header == ["id", "name"]
