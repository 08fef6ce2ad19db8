"""Every registered query with SQL against DuckDB, and the others for rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from lineloom.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = db.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(str(tuple(r[k] for k in at)) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())
