"""Every registered query of the library against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from millrace import queries
from millrace.plans.views import TABLES

QUERIES, ORACLES = queries.collect("QUERIES"), queries.collect("ORACLES")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 5) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 5) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
