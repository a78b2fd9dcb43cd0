"""Every registered query of the package on the smallest tables."""

import pytest
from compare import connect, difference

from lodestar.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        assert difference(df, connect(FOLDER), ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
