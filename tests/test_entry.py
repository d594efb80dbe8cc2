import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", ["p1_found", "p2_report", "p5_found", "clone_groups_lexical", "attention_hotspots", "policy_findings", "exclusion_precedence", "planted_callables", "input_lists", "evidence_binding", "source_callables"])
def test_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.columns and df.count() >= 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
