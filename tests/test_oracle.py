"""Every registered query against its SQL twin on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkcols.plans import registry

QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows_by_name(columns, rows):
    """Rows with their columns in name order, sorted as text so NULLs and types mix."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(columns, result.fetchall())


def test_only_file_sizes_lack_sql():
    assert set(QUERIES) - set(SQL) == {"stored_bytes_parquet"}
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"l_returnflag", "total", "average", "minimum", "maximum"}
    assert df.count() == 3
