"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _names():
    from __spark_entry__ import queries

    return sorted(queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    info = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert info["ok"] is not False, info


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0 and "accuracy" in df.columns
