"""Every query that SQL can express gives what DuckDB gives over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, con, name):
    found = catalog.queries()[name](spark, DATA)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in sorted(names)) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in sorted(names)) for row in found.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_repeats_itself(spark, name):
    first, again = (sorted(map(str, catalog.queries()[name](spark, DATA).collect())) for _ in range(2))
    assert first and first == again
