"""The queries of this subpackage on the smallest tables: against SQL where there is some, else that they give rows."""

import os

import duckdb
import pytest

from folioweave.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, name):
    frame = queries()[name](spark, sf)
    columns = sorted(frame.columns)
    rows = frame.select(*columns).collect()
    assert rows
    if name in oracle_sql():
        connection = duckdb.connect()
        for file in os.listdir(sf):
            connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{file}')")
        relation = connection.sql(oracle_sql()[name])
        expected = relation.select(*[f'"{c}"' for c in columns]).fetchall()
        plain = lambda rs: sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rs)
        assert plain(rows) == plain(expected)


def test_nothing_else_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "folioweave"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "folioweave.llm" not in path.read_text()
