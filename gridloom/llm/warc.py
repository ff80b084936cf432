"""WARC archives, their capture index, and reading back through the merged index.

Writing. Captures are dealt by payload digest; each task writes one archive of
gzip members, a response record for the first capture of a payload (that with the
smallest page id) and revisit records for the others, and returns the archive's
index run, sorted by URL key, timestamp and page id. An archive's name holds its
task attempt, so an attempt that is lost or repeated leaves a file that no index
row names. Digests that a large share of all pages has (an error page, an empty one) are
dealt row by row, so no payload is bound to one task.

Index. Runs are cut into ranges of the key; a range's slices of all runs are merged
by a loser tree, so concatenating the ranges gives every URL's captures in order. An
exchange may cut a run and promises no order, so a run's slice is put in order again
before it enters the tree. A range holds a bounded number of index rows, and a host with very many captures
is cut by time like any other range.

Reading. Records are fetched through the merged index, each archive's in order of their
offsets, and payloads are held against their digests.

Defined cases: null html is an empty payload; null URLs have an empty key; null page
ids rank after all others and are never referred to; rows that repeat the smallest
page id of a payload are all responses; payloads below ``min_bytes`` are all
responses; captures of equal URL key and time are ordered by page id; a payload of any
length is one record; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pieces, scratch_path, spread_join, stage

#: Bytes of an archive that one task reads in a row.
READ_BYTES = 64 << 20
#: Index rows of a run; a task that writes more yields several runs.
RUN_ROWS = 50_000
INDEX = (
    "run string, urlkey string, ts long, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"
)
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, ts long"
_INDEX_SCHEMA = pa.schema(
    [(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in INDEX.split(", "))]
)
_RECORD_SCHEMA = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in RECORDS.split(", "))])


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host parts reversed, then path and sorted query."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").removeprefix("www."), p.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    query = "&".join(sorted(p.query.split("&"))) if p.query else ""
    return f"{key}){p.path or '/'}" + (f"?{query}" if query else "")


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    value = (urn or "<urn:page:none>").removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, ts: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, a revisit if it refers to another page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_page_urn(page_id)}",
        f"WARC-Date: {datetime.fromtimestamp(ts, UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and the payload length that the HTTP header states, of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload, stated


def compress(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        fs, path = pafs.FileSystem.from_uri(name)
        rows, out, offset, runs = [], None, 0, 0
        for b in pieces(batches, 256):
            if out is None and b.num_rows:
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            for page, url, ts, payload, refers in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                digest = bare_digest(payload)
                member = compress(record(page, url, ts, payload, digest, refers))
                out.write(member)
                kind = "response" if refers is None else "revisit"
                rows.append((f"{name}#{runs}", url_key(url), ts, page, url, kind, digest, len(payload), refers, name, offset, len(member)))
                offset += len(member)
            if len(rows) >= RUN_ROWS:
                yield _index_batch(sorted(rows, key=_index_key))
                rows, runs = [], runs + 1
        if out is not None:
            out.close()
        if rows:
            yield _index_batch(sorted(rows, key=_index_key))

    return run


def _index_key(row: tuple) -> tuple:
    """URL key, timestamp, page id with null last."""
    return row[1], row[2], row[3] is None, row[3] or 0


class LoserTree:
    """k-way merge of sorted iterators; each step costs one path of log2(k) comparisons."""

    def __init__(self, runs: Iterable[Iterable[Any]], key: Callable[[Any], Any]):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.head: list[Any] = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.head]
        self.losers = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes first; an ended run loses, ties go to the lower number."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        """Replay the path of a leaf; losers stay in its nodes, the winner is losers[0]."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while building: the first to arrive waits here
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while self.k:
            w = self.losers[0]
            if self.keys[w] is None:
                return
            yield self.head[w]
            nxt = next(self.runs[w], None)
            if nxt is not None and self.key(nxt) < self.keys[w]:
                raise ValueError("an index run is not sorted")
            self.head[w], self.keys[w] = nxt, None if nxt is None else self.key(nxt)
            self._play(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs' slices that fall into this range."""
    slices: dict[str, list[pa.RecordBatch]] = {}
    for b in batches:
        for run in pc.unique(b.column(0)).to_pylist():
            slices.setdefault(run, []).append(b.filter(pc.equal(b.column(0), run)))

    def rows(parts: list[pa.RecordBatch]) -> list[tuple]:
        return sorted((r for p in parts for r in zip(*(c.to_pylist() for c in p.columns), strict=True)), key=_index_key)

    held: list[tuple] = []
    for row in LoserTree([rows(slices[r]) for r in sorted(slices)], _index_key):
        held.append(row)
        if len(held) == 4096:
            yield _index_batch(held)
            held = []
    if held:
        yield _index_batch(held)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_SCHEMA.types, strict=True)], schema=_INDEX_SCHEMA)


class _Archives:
    """Open archives, the least recently used one closed beyond a limit."""

    def __init__(self, most: int = 64):
        self.most, self.files = most, OrderedDict()

    def record(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            fs, path = pafs.FileSystem.from_uri(name)
            self.files[name] = fs.open_input_file(path)
            if len(self.files) > self.most:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return zlib.decompress(self.files[name].read_at(length, offset), 31)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archives = _Archives()
    for b in pieces(batches, 1024):
        out = []
        for key, ts, name, offset, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            headers, payload, stated = parse(archives.record(name, offset, length))
            digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
            if kind == "response" and (bare_digest(payload) != digest or len(payload) != stated):
                raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
            refers = _page_of(headers.get("WARC-Refers-To"))
            out.append((_page_of(headers["WARC-Record-ID"]), stated, digest, kind, refers, key, ts))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORD_SCHEMA.types, strict=True)], schema=_RECORD_SCHEMA)


def write_archives(pages: DataFrame, first_second: int = 1_704_067_200, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) and return the staged index runs.

    Archives go to ``folder``, by default to a scratch folder that goes with the session.
    A capture's timestamp is ``first_second`` plus its page id, as the table has no times.
    """
    spark = pages.sparkSession
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        (F.coalesce(F.col("page_id").cast("long"), F.lit(0)) % 1_000_000_000 + first_second).alias("ts"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    )
    keyed = own.withColumn("digest", F.unhex(F.sha1("payload")))
    first = stage(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")), "warc-first")
    total = first.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    refers = F.when((F.length("payload") >= min_bytes) & ((F.col("first") < F.col("page_id")) | (F.col("page_id").isNull() & F.col("first").isNotNull())), F.col("first"))
    dealt = spread_join(keyed, first, "digest", "copies", total).select("page_id", "url", "ts", "payload", refers.alias("refers_to"))
    return stage(dealt.mapInArrow(_write(folder or scratch_path(spark, "warc")), INDEX), "warc-runs", keep=True)


def merge_index(runs: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """Index rows in global order of URL key, timestamp and page id: range by range, in order within each."""
    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // rows_per_range))
    return runs.repartitionByRange(ranges, "urlkey", "ts", F.col("page_id").asc_nulls_last()).mapInArrow(_merge, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """One row per index entry, from the archives, which are read from front to back."""
    entries = index.select("urlkey", "ts", "file", "offset", "length")
    part = F.floor(F.col("offset") / READ_BYTES)
    # an explicit number: entries are small beside their records, and would be coalesced into few tasks
    size = entries.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return entries.repartition(tasks, "file", part).sortWithinPartitions("file", "offset").mapInArrow(_read, RECORDS)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages, merge the index and read every record back through it."""
    return read_records(stage(merge_index(write_archives(pages, min_bytes=min_bytes)), "warc-index"))
