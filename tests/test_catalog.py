"""Every query with a SQL twin gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from castwise.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted((tuple(repr(v) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    twin = duck.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({ORACLES[name]})")
    twin_types = [str(d[1]) for d in twin.description]
    assert [TYPES.get(df.schema[n].dataType.simpleString()) for n in names] == twin_types
    expected = twin.fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    assert _sorted(got) == _sorted(expected)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
