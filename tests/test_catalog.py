"""Every query against the SQL of a second engine, on the driver's smallest tables."""

import math

import duckdb
import pytest

from glyphloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "conversations")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, engine, name):
    made = catalog.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in made.collect()), key=repr)
    found = engine.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    made = catalog.QUERIES[name](spark, SF)
    assert made.count() > 0 and len(set(made.columns)) == len(made.columns)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
