import pytest

from seqspark.plans import registry

from .helpers import oracle, values

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    got = values(df.columns, df.collect())
    if name in SQL:
        columns, want = oracle(SQL[name], SF)
        assert sorted(df.columns) == columns
        assert got == want
    assert got
