"""Every registered query against its independent SQL."""

from __future__ import annotations

import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registered

FOLDER = registered.SMOKE_DIR
# The corpus subpackage tests its own queries.
QUERIES = {k: q for k, q in registered.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
SQL = registered.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or pd.isna(v):
            return "NULL"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(float(v))
        return str(v)

    rows = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(value, r)) for r in rows.itertuples(index=False, name=None))


def test_every_query_but_one_has_sql():
    assert set(QUERIES) - set(SQL) == {"link_by_title"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in SQL:
        want = duck.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
