"""Every query of the subpackage runs over the whole smallest tables with the columns it must have."""

import os

import pytest

from terravane.llm import queries
from tests.compare import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {"p2_found": ["point_id"], "p3_found": ["point_id", "cluster_no"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "found_lang"]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLE:
        said = compare(name, queries.QUERIES[name], queries.ORACLE[name], spark, SF)
        assert said.startswith("match"), said
        return
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0
    assert name not in COLUMNS or df.columns == COLUMNS[name]
