"""Registered queries of the subpackage against their SQL twins, and their names."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_queries_match_sql_twins(spark):
    from compare import compare

    from driftline.llm.oracle_sql import ORACLE
    res = compare(spark, SF, names=list(ORACLE), verbose=False)
    assert {k: v["status"] for k, v in res.items()} == dict.fromkeys(ORACLE, "match")
