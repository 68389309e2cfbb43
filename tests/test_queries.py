"""Every registered query of the reference operators against its SQL, or for rows where it has none."""

import importlib

import pytest

from tests.compare import connect, rows

for _name in ("basics", "tables", "statistics", "models"):
    importlib.import_module(f"regionfx.queries.{_name}")
from regionfx import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    expected = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.collect(), df.columns) == rows(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert not catalog.QUERIES[name](spark, sf_dir).isEmpty()
