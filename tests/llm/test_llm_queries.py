from __future__ import annotations

import pytest

from reelgrid.llm import queries
from tests.compare import against_sql
from tests.conftest import DATA, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    if name in queries.SQL:
        against_sql(df, queries.SQL[name], DATA)
    else:
        rows = [tuple(map(str, r)) for r in df.collect()]
        assert not name.endswith("_found") or len(rows) == len(set(rows))
