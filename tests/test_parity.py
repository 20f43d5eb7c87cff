"""Every registered query with a SQL twin gives the twin's rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from hazardframe.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(table, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0 if isinstance(v, float) else v)
    return sorted(columns), sorted(tuple(clean(r[i]) for i in order) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLES[name])
    assert got == rows(cursor.fetchall(), [d[0] for d in cursor.description])


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
