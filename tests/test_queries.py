"""Every core query against its SQL on the smallest tables, and without SQL against a plain expectation of its rows."""

import os

import duckdb
import pytest

from folioweave.plans import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{file}')")
    return connection


def plain(rows):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    assert plain(frame.select(*columns).collect()) == plain(relation.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_names_do_not_need_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert done.returncode == 0, done.stderr
