"""Every reference query against its SQL on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, oracle, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = oracle.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in got.fetchall())
