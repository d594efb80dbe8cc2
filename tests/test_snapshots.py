import datetime as dt
import random

from sievework.operators.snapshots import snapshot_changes

SCHEMA = "workspace_id long, subject_key string, run_id long, run_seq int, relative_path string, content_sha256 string, ingested_at timestamp, path string, run string"
T = dt.datetime(2025, 1, 1)


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(parts)
    out = snapshot_changes(df, group=["workspace_id", "subject_key"], run="run_id", sequence="run_seq", path="relative_path", digest="content_sha256", arrived="ingested_at")
    got = [(r.run, r.subject_key, r.path, r.change_kind) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_cases(spark):
    rows = [
        (1, "s", 11, 1, "a/b.py", "0A", T), (1, "s", 11, 1, "x.py", "1", T), (1, "s", 11, 1, "gone.py", "2", T),
        (1, "s", 12, 2, ".\\a\\\\b.py", "a", T), (1, "s", 12, 2, "x.py", "3", T), (1, "s", 12, 2, "x.py", "1", T + dt.timedelta(1)), (1, "s", 12, 2, "new.py", None, T),
        (1, "s", 13, 3, "x.py", "9", T), (1, "s", 13, 3, "new.py", "7", T), (1, "s", 13, 3, None, "7", T), (1, "s", None, 4, "new.py", "7", T),
        (1, None, 11, 1, "n.py", "1", T), (1, None, 12, 2, "n.py", "2", T),
    ]
    assert run(spark, rows + rows[:4]) == {
        (12, "s", "gone.py", "removed"), (12, "s", "new.py", "added"),
        (13, "s", "a/b.py", "removed"), (13, "s", "x.py", "changed"), (12, None, "n.py", "changed"),
    }


def test_subject_missing_from_a_run(spark):
    rows = [(1, "s", 1, 1, "a", "1", T), (1, "t", 2, 2, "a", "1", T), (1, "s", 3, 3, "a", "2", T), (1, "s", 3, 3, "b", "2", T)]
    assert run(spark, rows) == {(3, "s", "a", "changed"), (3, "s", "b", "added")}


def test_a_run_without_files_still_counts(spark):
    rows = [(1, "s", 1, 1, "a", "1", T), (1, "s", 2, 2, None, None, T), (1, "s", 3, 3, "a", "1", T)]
    assert run(spark, rows) == {(2, "s", "a", "removed"), (3, "s", "a", "added")}


def test_against_brute_force(spark):
    random.seed(3)
    rows = []
    for ws in (1, 2):
        for s in ("hot", "u", "v"):
            for r in range(1, 6):
                if s == "v" and r == 3:
                    continue
                for f in random.sample(range(60), 40 if s == "hot" else 8):
                    rows.append((ws, s, ws * 10 + r, r, f"f{f}", random.choice(["1", "2", None]), T + dt.timedelta(random.random())))
    want = set()
    for ws, s in {(r[0], r[1]) for r in rows}:
        snaps: dict = {}
        for r in sorted((r for r in rows if r[:2] == (ws, s)), key=lambda r: r[6]):
            snaps.setdefault((r[3], r[2]), {})[r[4]] = r[5]
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            x, y = snaps[a], snaps[b]
            want |= {(b[1], s, p, "added") for p in y.keys() - x.keys()} | {(b[1], s, p, "removed") for p in x.keys() - y.keys()}
            want |= {(b[1], s, p, "changed") for p in x.keys() & y.keys() if x[p] and y[p] and x[p] != y[p]}
    assert run(spark, rows + rows[::7], parts=9) == want


def test_empty(spark):
    assert run(spark, [], parts=1) == set()
