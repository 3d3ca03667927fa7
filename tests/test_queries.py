"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessella import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, tables, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = sorted("|".join(shown(r[c]) for c in columns) for r in df.collect())
    found = tables.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted("|".join(shown(r[i]) for i in order) for r in found.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
