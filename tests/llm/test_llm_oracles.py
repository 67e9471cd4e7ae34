"""Registered queries against their SQL; those that have none run and give a row per document."""
import pytest

import check
from sheetmetric.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, name):
    problem, _, _ = check.compare(spark, check.connect(SF), Q.QUERIES[name], Q.ORACLES[name], SF)
    assert problem == ""
