"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from skeinwork.plans import stores  # noqa: F401
from skeinwork.plans.oracles import ORACLES
from skeinwork.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def value(v):
    return str(v) if isinstance(v, bool) or not isinstance(v, (int, float)) else repr(round(float(v), 6) + 0.0)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    assert rows
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        have = [d[0] for d in r.description]
        assert sorted(have) == names
        assert rows == sorted(tuple(value(row[have.index(c)]) for c in names) for row in r.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
