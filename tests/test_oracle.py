"""Every registered query against its SQL in DuckDB, on the smallest data."""

from __future__ import annotations

import os

import pytest

import check
from sealwright import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def database():
    return check.database(FOLDER)


SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, database, name):
    state, note = check.compare(spark, database, FOLDER, name, catalog.queries()[name], SQL.get(name))
    assert state == "ok", note


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 20
    assert all(row.content_id.startswith("bundle:sha256:") for row in rows)
