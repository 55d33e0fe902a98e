"""Every registered query that has SQL, against DuckDB."""

import pytest
from albumen.plans import registry
from oracle import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, SF))
    want_columns, want = duck(SF, registry.ORACLES[name])
    assert columns == want_columns and rows == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
