"""Every query outside the optional subpackage against its SQL on the smallest tables; those without SQL must run."""

import os

import pytest

from tests.compare import compare
from terravane.plans import core_queries, io_queries, reference_queries

SF = "/root/testdata/sf0.001"
ALL = core_queries.QUERIES | reference_queries.QUERIES | io_queries.QUERIES
SQL = core_queries.ORACLE | reference_queries.ORACLE | io_queries.ORACLE
#: These need both classes among the training samples.
LARGER = {"permutation_importance", "rf_probability", "forest_search", "perceptron_probability"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, name):
    said = compare(name, ALL[name], SQL.get(name), spark, SF.replace("0.001", "0.01") if name in LARGER else SF)
    assert said.startswith("match" if name in SQL else "rows"), said


def test_names_are_unique():
    assert not set(core_queries.QUERIES) & set(reference_queries.QUERIES)
