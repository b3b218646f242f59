"""Every core query runs over its whole tables and, where SQL can say it, agrees with SQL."""

import pytest

from gradeworks import registry
from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, oracle, name):
    names, rows = rows_of(registry.QUERIES[name](spark, data))
    assert names
    if name in registry.SQL:
        assert (names, rows) == rows_of_sql(oracle, registry.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
