"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest
from harness import compare

from featforge.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    verdict, _, _ = compare(spark, FOLDER, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert verdict in ("ok", "rows-only"), verdict


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 120
