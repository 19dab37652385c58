"""Every core query against its SQL; the few without SQL have tests of their own."""

from __future__ import annotations

import pytest

from reelgrid.plans import registry
from tests.compare import against_sql
from tests.conftest import DATA, needs_data

NO_SQL: set[str] = set()


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    if name in registry.SQL:
        against_sql(df, registry.SQL[name], DATA)
    else:
        assert name in NO_SQL
        df.collect()


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) - set(registry.SQL) == NO_SQL


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert "p4_found" in __spark_entry__.queries()
