"""Every fourth query beside its SQL twin on the smallest data; tools/check.py runs them all."""

import duckdb
import pytest
from conftest import SMALL

from inkframe import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES)[::4])
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    res = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in res.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(res.fetchall(), key=key)


def test_every_query_has_rows_or_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 180
