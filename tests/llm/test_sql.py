"""The registered queries that have SQL, against it on the small tables."""

import duckdb
import pytest

from gridloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    expected = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in got.fetchall())
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == expected


def test_url_keys_of_sql_are_those_of_the_operator():
    from gridloom.llm.warc import url_key

    urls = ["http://WWW.Example.com:80/A?b=2&a=1#x", "https://a.b.org", "http://x.org:8080", "http://x.org/?", "https://x.org/p#top?q=1", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, '')", [list(r) for r in enumerate(urls)])
    rows = con.execute(f"SELECT page_id, urlkey, record_type, refers_to FROM ({queries.WARC_SQL}) ORDER BY page_id").fetchall()
    assert [r[1] for r in rows] == [url_key(u) for u in urls]
    assert [r[2:] for r in rows] == [("response", None)] + [("revisit", 0)] * (len(urls) - 1)
