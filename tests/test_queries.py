"""Every registered query of the engine against DuckDB at the smallest size."""

import os

import duckdb
import pytest

from shapeframe.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(str(r[i]) if not isinstance(r[i], (bool, int, float, str, type(None))) else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    mine = QUERIES[name](spark, FOLDER)
    theirs = oracle.sql(ORACLE_SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs.columns, theirs.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
