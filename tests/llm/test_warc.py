import base64
import hashlib
import heapq

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import warc


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


def test_loser_tree_rejects_unsorted_runs():
    try:
        list(warc.LoserTree([[2, 1], [0]], lambda x: x))
    except ValueError:
        return
    raise AssertionError


def test_url_keys():
    assert warc.url_key("HTTP://WWW.Example.com:80/A?b=2&a=1") == "com,example)/A?a=1&b=2"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad" and warc.url_key("http://x.org:8080") == "org,x:8080)/"


def test_records_round_trip():
    for refers in (None, 3):
        raw = warc.record(9, "http://a/\r\nX: y", 1_700_000_000, b"\r\n\r\nbody\xff", warc.bare_digest(b"\r\n\r\nbody\xff"), refers)
        headers, payload, stated = warc.parse(raw)
        assert stated == 9 and payload == (b"" if refers else b"\r\n\r\nbody\xff") and "X" not in headers


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, first string")


def collect(df):
    return sorted((r["page_id"] if r["page_id"] is not None else 10**9, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


def expected(rows, min_bytes=0):
    out, first = [], {}
    for i, _, h in rows:
        d = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        if i is not None:
            first[d] = min(first.get(d, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = len(raw) >= min_bytes and d in first and (i is None or first[d] < i)
        out.append((10**9 if i is None else i, len(raw), d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=lambda r: r[:3])


def test_defined_cases(spark):
    rows = [(5, "http://b.org/", "same é"), (2, "http://a.org/x", "same é"), (9, None, None), (8, "http://a.org/x", ""), (2, "http://a.org/x", "same é"), (None, "http://z.org", "same é"), (None, "u", "only"), (11, "bad url", "x" * 70_000)]
    assert sorted(collect(warc.archive(pages(spark, rows))), key=lambda r: r[:3]) == expected(rows)
    assert sorted(collect(warc.archive(pages(spark, rows), min_bytes=5)), key=lambda r: r[:3]) == expected(rows, 5)
    assert warc.archive(pages(spark, [])).count() == 0


def test_index_is_globally_ordered(spark):
    rows = [(i, f"http://host{i % 3}.org/p{i % 7}", f"body {i % 40}") for i in range(200)]
    runs = warc.write_archives(pages(spark, rows))
    merged = warc.merge_index(runs, rows_per_range=25)
    parts = merged.rdd.mapPartitionsWithIndex(lambda k, it: [(k, [(r["urlkey"], r["ts"], r["page_id"]) for r in it])]).collect()
    flat = [x for _, xs in sorted(parts) for x in xs]
    assert flat == sorted(flat) and len(flat) == 200


def test_query(spark, sf_dir):
    from gridloom.llm.queries import queries

    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(collect(queries()["op2_warc"](spark, sf_dir)), key=lambda r: r[:3]) == expected(rows)


def test_one_digest_on_nearly_all_rows(spark):
    rows = [(i, f"http://h{i % 9}.org/{i}", "error page" if i % 100 else f"page {i}") for i in range(1, 700)]
    assert sorted(collect(warc.archive(pages(spark, rows))), key=lambda r: r[:3]) == expected(rows)


def test_runs_cut_into_pieces_are_merged_in_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    rows = [(i, f"http://host{i % 3}.org/p{i % 7}", f"body {i}") for i in range(120)]
    index = warc.write_archives(pages(spark, rows)).collect()
    import pyarrow as pa

    table = pa.Table.from_pylist([r.asDict() for r in index], schema=warc._INDEX_SCHEMA)
    backwards = table.take(list(range(len(index) - 1, -1, -1))).to_batches(max_chunksize=5)
    got = [(r["urlkey"], r["ts"], r["page_id"]) for b in warc._merge(iter(backwards)) for r in b.to_pylist()]
    assert got == sorted(got) and len(got) == 120
