"""Every query of the library: against its DuckDB twin, or rows where SQL has no form for it."""

import pytest
from twins import DATA, same

from leafmill.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    same(QUERIES[name](spark, DATA), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
