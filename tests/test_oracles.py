"""Every registered query against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import pathlib

import duckdb
import pytest

from logwarden.catalog.oracles import ORACLES
from logwarden.catalog.queries import QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def ordered(rows):
    return sorted((tuple(r) for r in rows),
                  key=lambda t: [(v is None, str(type(v)), str(v)) for v in t])


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in pathlib.Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = ordered(df.select(*columns).collect())
    relation = duck.execute(ORACLES[name])
    found = {d[0]: (i, str(d[1])) for i, d in enumerate(relation.description)}
    assert sorted(found) == columns
    for column, kind in df.dtypes:
        assert TYPES[kind] == found[column][1], column
    expected = ordered([[r[found[c][0]] for c in columns] for r in relation.fetchall()])
    assert got == expected
    assert expected, "the query should find something"
