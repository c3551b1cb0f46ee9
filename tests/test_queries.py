"""Every query with SQL gives what DuckDB gives; the others run."""

from __future__ import annotations

import pytest
from conftest import SMALL, rows

from ledgerlens.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name: str) -> None:
    found = registry.QUERIES[name](spark, SMALL).toPandas()
    assert len(set(found.columns)) == len(found.columns)
    if name in registry.ORACLES:
        expected = duck.sql(registry.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_entry_has_rows(spark) -> None:
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
