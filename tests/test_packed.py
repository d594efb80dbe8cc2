import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.operators.packed import _unescape, split_cells, split_packed

VALUE = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-/")


def brute(cell):
    """One cell, one character at a time."""
    out, i = [], 0
    while cell is not None and i < len(cell):
        c = cell[i]
        if c in "\"'":
            j = i + 1
            while j < len(cell):
                if cell[j] == "\\":
                    j += 2
                elif cell[j] == c:
                    if cell[j + 1 : j + 2] != c:
                        break
                    j += 2
                else:
                    j += 1
            body = cell[i + 1 : min(j, len(cell))]
            out += [_unescape(body, c)] if body else []
            i = min(j, len(cell)) + 1
        elif c in VALUE:
            j = i
            while j < len(cell) and cell[j] in VALUE:
                j += 1
            word = cell[i : j - 1] if cell[j : j + 1] in ('"', "'") and cell[j : j + 1] and cell[j - 1].isalpha() else cell[i:j]
            out += [word] if word else []
            i = j
        else:
            i += 1
    return out


def test_notations():
    cells = ["['a', 'b']", '["say \\"x\\"","y"]', "a | \"b, c\";; d", "[u'a' , u'b']", '"say ""x"""', "", None, "  ", "('a',)", "itém", '"open, a', '""']
    want = [["a", "b"], ['say "x"', "y"], ["a", "b, c", "d"], ["a", "b"], ['say "x"'], [], [], [], ["a"], ["it", "m"], ["open, a"], []]
    assert split_cells(pa.array(cells)).to_pylist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab\"'\\, é-u[n", max_size=12)), max_size=40))
def test_against_brute_force(cells):
    assert split_cells(pa.array(cells, pa.string())).to_pylist() == [brute(c) for c in cells]


def test_escapes():
    assert _unescape("\\u00e9\\n\\x41\\q\\\\", '"') == "é\nA\\q\\"
    assert _unescape("\\ud83d\\ude80", '"') == "🚀"


def test_operator(spark):
    rows = [(1, "a;b", "x"), (1, "a;b", "x"), (2, None, ""), (3, "q" * 200_000, None)]
    df = spark.createDataFrame(rows, "cell_id long, raw string, column_name string").withColumn("val", __import__("pyspark").sql.functions.lit("clash"))
    got = split_packed(df, "cell_id", {"raw": "raw", "column_name": "column_name"}).collect()
    assert sorted((r.cell_id, r.field, r.pos, len(r.val)) for r in got) == [(1, "column_name", 0, 1), (1, "raw", 0, 1), (1, "raw", 1, 1), (3, "raw", 0, 200_000)]
    assert split_packed(df.where("false"), "cell_id", {"raw": "raw"}).count() == 0


def test_batch_order_does_not_matter(spark):
    random.seed(4)
    rows = [(i, "".join(random.choice("ab'\",; ") for _ in range(9))) for i in range(500)]
    a = spark.createDataFrame(rows, "cell_id long, raw string").repartition(7)
    got = {(r.cell_id, r.pos): r.val for r in split_packed(a, "cell_id", {"raw": "raw"}).collect()}
    assert got == {(i, k): v for i, c in rows for k, v in enumerate(brute(c))}
