"""Every query of the catalogue against its SQL in DuckDB, and those without SQL for their shape."""

import math

import duckdb
import pytest

from touchline.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF_DIR)
    own = rows_of(found.columns, [tuple(r) for r in found.collect()])
    answer = duck.execute(catalog.oracle_sql()[name])
    other = rows_of([d[0] for d in answer.description], answer.fetchall())
    assert own[0] == other[0]
    assert len(own[1]) == len(other[1]) and own[1]
    for a, b in zip(own[1], other[1], strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0
