import datetime as dt
import random

import numpy as np

from sievework.operators.orphans import KeySet, Target, orphan_references, orphan_report

DAY = dt.datetime(2025, 1, 1)
CONTRIBUTIONS = "contribution_id long, recorded_at timestamp, a string, b string, id string"
TARGET = "key string, recorded_at timestamp, deleted_at timestamp"


def run(spark, refs, a, b):
    targets = [Target("a", spark.createDataFrame(a, TARGET), "key", "recorded_at", "deleted_at"), Target("b", spark.createDataFrame(b, TARGET), "key", "recorded_at", "deleted_at")]
    out = orphan_references(spark.createDataFrame(refs, CONTRIBUTIONS), "contribution_id", "recorded_at", targets, period_days=3)
    return out, {(r.id, r.field, r.reason) for r in out.collect()}


def test_reasons(spark):
    t = DAY + dt.timedelta(days=10)
    refs = [(1, t, " K1 ", None, "x"), (2, t, "k2", "n/a", "x"), (3, t, "k3", " ", "x"), (4, t, "nowhere", "-", "x"), (5, t, None, "NONE", "x"), (4, t, "nowhere", "-", "x"), (6, None, "k1", "k9", "x"), (7, t, "k4", None, "x")]
    early, late = DAY, DAY + dt.timedelta(days=20)
    a = [("k1", early, None), ("k2", late, None), ("k3", early, t), ("K3", late, None), (None, early, None), ("k4", None, None)]
    out, got = run(spark, refs, a, [])
    assert got == {(2, "a", "late"), (3, "a", "deleted"), (4, "a", "missing"), (6, "b", "missing"), (7, "a", "late")}
    assert out.count() == 5
    report = {(r.table_name, r.reason): r.n for r in orphan_report(out, tables={"a": "A", "b": "B"}).collect()}
    assert report[("A", "missing")] == 1 and report[("B", "missing")] == 1


def test_against_brute_force(spark):
    random.seed(7)
    at = lambda: DAY + dt.timedelta(hours=random.randrange(24 * 30))
    keys = ["hot"] + [f"k{i}" for i in range(40)]
    a = [(random.choice(keys[:30]), at(), random.choice([None, at()])) for _ in range(120)]
    refs = [(i, at(), "hot" if i % 3 == 0 else random.choice(keys), None, "") for i in range(900)]
    _, got = run(spark, refs, a, [])
    want = set()
    for i, t, k, *_ in refs:
        own = [(r, d) for key, r, d in a if key == k]
        if not any(r <= t and (d is None or d > t) for r, d in own):
            want.add((i, "a", "missing" if not own else "late" if min(r for r, _ in own) > t else "deleted"))
    assert got == want


def test_empty(spark):
    _, got = run(spark, [], [], [])
    assert got == set()


def test_bitmaps():
    random.seed(1)
    for n, m in ((10, 10), (9000, 20), (20, 9000), (9000, 9000), (0, 5)):
        a, b = (np.array(random.sample(range(1 << 16), k), dtype=np.int64) for k in (n, m))
        assert sorted(KeySet(a).and_not(KeySet(b)).tolist()) == sorted(set(a.tolist()) - set(b.tolist()))
