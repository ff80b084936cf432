"""Lexical retrieval packing: token windows filled with BM25 neighbours.

Documents are tokenised once into a staged table. Document frequencies, the number
of documents and their mean length are counted over the whole corpus (a fixed-size
vector over the token vocabulary), so every shard scores with the same statistics.
A document fills windows of its own first; only the rest of it is moved.

Rests are routed by content: a route is the three heaviest BM25 terms of a rest.
Routes are laid out by their first term, in proportion to its tokens, and cut into
shards of about ``shard_tokens`` tokens (a document counts for some tokens more, so short
texts do not pile up either); a route that alone holds more is dealt over shards of its
own, row by row. So texts that share their heaviest terms meet, however many shards
there are. A shard builds a BM25 inverted index of its rests; a seed asks with all its
terms for unused neighbours (``query_terms`` limits them to the heaviest), which fill
its window in score order, equal scores in order of ids. The last one is cut at the
window's end and seeds the next window with what is left of it, so windows are full.
What is left at a shard's end is cut into sequences of power-of-two lengths, which need
no padding either.

Token ids are those of the ``tokenizers`` vocabulary file; an added token of it
(``<|endoftext|>``) that a text spells gets its own id wherever it stands.

Defined cases: null or empty text is the end token alone; null ids are kept as they
are; repeated rows are packed once each, spread like any other; a text of any length is
tokenised whole and fills windows of its own first; other columns are not looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pieces, scope, stage

K1, B = 1.2, 0.75
#: Terms that at least this share of a shard's documents holds are kept as full rows of weights.
FREQUENT = 1 / 16
#: Tokens that a document counts for beyond its own when shards are cut: bounds the documents of a shard.
DOCUMENT = 32
#: Terms of a route.
ROUTED = 3
#: Numbers of shards that large routes are dealt to, and of sequences that hold full windows.
LARGE_SHARDS, FULL_WINDOWS = 1 << 28, 1 << 62
#: Longest list of large routes that is broadcast (16 bytes a row); beyond it the list is joined by shuffling.
BROADCAST_ROWS = 50_000
#: Runs of blanks that tiktoken encodes; texts with longer ones take the slower library.
LONG_BLANKS = 100_000
_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file, encoded by tiktoken; texts with very long blanks by ``tokenizers`` itself.

    tiktoken's pattern backtracks over white space and gives up on runs of about a million characters.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path, self.library = path or public_tokenizers.path("byte_bpe_50k.json"), None
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        ranks = {bytes(letters[c] for c in k): v for k, v in vocabulary.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if [vocabulary["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("the vocabulary's ids do not follow its merges")
        if max([*ranks.values(), *self.added.values()]) >= 1 << 16:
            raise ValueError("token ids must fit 16 bits")
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    def ids(self, text: str) -> np.ndarray:
        """All ids of a whole text."""
        if len(text) > LONG_BLANKS and max(map(len, re.findall(r"\s+", text)), default=0) > LONG_BLANKS:
            if self.library is None:
                import tokenizers

                self.library = tokenizers.Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2")
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u2")


def encoder(path: str | None) -> Encoder:
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def _tokens(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(path), np.array([end_id], dtype="<u2").tobytes()
        for b in pieces(batches):
            ids = [known.ids(t or "").tobytes() + end for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, ids): 16-bit little-endian token ids of every whole text, with the end token."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _tokens(vocabulary, end_id), "doc_id long, ids binary"
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs, tokens = np.zeros(1 << 16, np.int64), 0, 0
    for b in batches:
        for ids in b.column(0).to_pylist():
            x = np.frombuffer(ids, "<u2")
            df[x] += 1  # once for each distinct id, however often it stands in x
            docs, tokens = docs + 1, tokens + len(x)
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2]).astype(np.int64)), pa.array(np.append(df[term], [docs, tokens]))], names=["term", "n"])


def corpus_statistics(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of each token id, documents and tokens of the whole corpus.

    What reaches the driver is bounded by the vocabulary: at most 65,538 numbers.
    """
    got = tokens.select("ids").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    at = {r["term"]: r["n"] for r in got}
    df = np.zeros(1 << 16, np.int64)
    for term, n in at.items():
        if term >= 0:
            df[term] = n
    return df, at.get(-1, 0), at.get(-2, 0)


class ShardIndex:
    """BM25 inverted index of one shard, scored with the corpus' statistics."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int | None = None):
        terms, owners, weights, self.queries = [], [], [], []
        for i, ids in enumerate(docs):
            term, tf = np.unique(ids, return_counts=True)
            w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length))
            terms.append(term)
            owners.append(np.full(len(term), i, np.int32))
            weights.append(w.astype(np.float32))
            best = np.argpartition(-w, query_terms)[:query_terms] if query_terms and len(w) > query_terms else slice(None)
            self.queries.append(np.sort(term[best]))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.start = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.n = len(docs)
        held = np.diff(self.start)
        frequent = np.flatnonzero(held >= max(2, FREQUENT * self.n))
        self.row = np.full(1 << 16, -1)  # of a frequent term in ``rows``
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.n), np.float32)
        for i, t in enumerate(frequent):
            at = slice(self.start[t], self.start[t + 1])
            self.rows[i, self.owner[at]] = self.weight[at]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the terms of one."""
        row = self.row[self.queries[doc]]
        q = self.queries[doc][row < 0]
        lo, n = self.start[q], self.start[q + 1] - self.start[q]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n) + self.rows[row[row >= 0]].sum(0)


def fill_windows(docs: list[np.ndarray], index: ShardIndex | None, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    sequence = 0
    tails = []
    for i, ids in enumerate(docs):
        full = len(ids) // window * window
        for at in range(0, full, window):
            yield i, at, window, sequence, 0
            sequence += 1
        if full < len(ids):
            tails.append(i)
    unused = np.zeros(len(docs), bool)
    unused[tails] = True
    at = {i: len(docs[i]) // window * window for i in tails}
    queue = iter(tails)
    pending: list[tuple[int, int, int]] = []  # pieces of the open window
    filled = 0
    seed = None  # the document whose rest opens the window

    def following() -> int | None:
        return next((i for i in queue if unused[i]), None)

    while True:
        if seed is None:
            seed = following()
            if seed is None:
                break
        unused[seed] = False
        ranked: np.ndarray | None = None
        doc: int | None = seed
        seed = None
        while doc is not None:
            take = min(window - filled, len(docs[doc]) - at[doc])
            pending.append((doc, at[doc], take))
            filled += take
            at[doc] += take
            if filled == window:
                offset = 0
                for d, s, n in pending:
                    yield d, s, n, sequence, offset
                    offset += n
                sequence, pending, filled = sequence + 1, [], 0
                seed = doc if at[doc] < len(docs[doc]) else None
                break
            if ranked is None:
                ranked = index.scores(pending[0][0])
            best = int(np.argmax(np.where(unused, ranked, -1.0)))
            doc = best if unused[best] else None
            if doc is not None:
                unused[doc] = False
    offset, room = 0, 0
    for d, s, n in pending:
        while n:
            if not room:
                room = 1 << (filled.bit_length() - 1)
                offset = 0
            take = min(room, n)
            yield d, s, take, sequence, offset
            s, n, room, offset, filled = s + take, n - take, room - take, offset + take, filled - take
            sequence += not room


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _whole_windows(window: int):
    """Pieces of the windows that documents fill alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = FULL_WINDOWS + (TaskContext.get().partitionId() << 36)
        for b in pieces(batches, 256):
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2")
                for at in range(0, len(ids) // window * window, window):
                    out.append((doc, at, window, _crc(ids[at : at + window]), len(ids), sequence, 0))
                    sequence += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_PIECES)

    return run


def route(ids: np.ndarray, idf: np.ndarray, mean_length: float) -> int:
    """The heaviest terms of a rest as one number, the heaviest in the highest bits."""
    term, tf = np.unique(ids, return_counts=True)
    w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length))
    out = 0
    for t in term[_heaviest(w)].tolist():
        out = out << 16 | t
    return out << 16 * (ROUTED - min(ROUTED, len(w)))


def _heaviest(w: np.ndarray) -> np.ndarray:
    """Places of the ROUTED heaviest weights, heaviest first, equal ones in order."""
    most = np.flatnonzero(w >= np.partition(w, -ROUTED)[-ROUTED]) if len(w) > ROUTED else np.arange(len(w))
    return most[np.argsort(-w[most], kind="stable")][:ROUTED]


def _routes(idf: np.ndarray, mean_length: float, window: int):
    """(route, weight) of every document's rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rests = [x[len(x) // window * window :] for x in (np.frombuffer(raw, "<u2") for raw in b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([route(x, idf, mean_length) for x in rests], pa.int64()), pa.array([len(x) + DOCUMENT for x in rests], pa.int64())], names=["route", "weight"])

    return run


@dataclass
class Shards:
    """Where routes lie: first terms side by side, each as wide as what it weighs."""

    start: np.ndarray
    width: np.ndarray
    tokens: int

    @classmethod
    def of(cls, weights: DataFrame, tokens: int) -> Shards:
        """From (route, weight) of the routes that fit into a shard; what reaches the driver is bounded by the vocabulary."""
        width = np.zeros(1 << 16)
        for r in weights.groupBy(F.shiftrightunsigned("route", 16 * (ROUTED - 1)).alias("term")).agg(F.sum("weight").alias("w")).collect():
            width[r["term"]] = r["w"]
        return cls(np.concatenate(([0], np.cumsum(width)[:-1])), width, tokens)

    def shard(self, route: int) -> int:
        """Routes of one first term are spread over its width by their other terms."""
        term, others = route >> 16 * (ROUTED - 1), route & (1 << 16 * (ROUTED - 1)) - 1
        spread = (others * 0x9E3779B1 & 0xFFFFFFFF) / (1 << 32)
        return int((self.start[term] + self.width[term] * spread) / self.tokens)


def _rests(idf: np.ndarray, mean_length: float, window: int, shards: Shards):
    """What a document's own windows leave of it, with its route and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids = [np.frombuffer(raw, "<u2") for raw in b.column(1).to_pylist()]
            starts = [len(x) // window * window for x in ids]
            routes = [route(x[s:], idf, mean_length) for x, s in zip(ids, starts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array(starts, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x[s:].tobytes() for x, s in zip(ids, starts, strict=True)], pa.binary()),
                    pa.array(routes, pa.int64()),
                    pa.array([shards.shard(r) for r in routes], pa.int64()),
                ],
                names=["doc_id", "at", "start", "doc_tokens", "ids", "route", "shard"],
            )

    return run


def _pack(idf: np.ndarray, mean_length: float, window: int, query_terms: int | None):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        names = ("doc_id", "at", "start", "doc_tokens", "ids")
        rows = sorted(zip(*(table.column(c).to_pylist() for c in names), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        docs = [np.frombuffer(r[4], "<u2") for r in rows]
        index = ShardIndex(docs, idf, mean_length, query_terms)
        out = [
            (rows[d][0], rows[d][2] + s, n, _crc(docs[d][s : s + n]), rows[d][3], (shard << 32) + sequence, offset)
            for d, s, n, sequence, offset in fill_windows(docs, index, window)
        ]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_PIECES)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    shard_tokens: int = 2 << 20,
    query_terms: int | None = None,
    vocabulary: str | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every document."""
    spark = docs.sparkSession
    tokens = stage(tokenise(docs, id_col, text_col, vocabulary), "pack-tokens")
    size = (F.length("ids") / 2).cast("long")
    with scope(spark):
        df, n, total = corpus_statistics(tokens)
        idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), total / max(n, 1)
        left = tokens.where(size % window != 0).withColumn("at", F.monotonically_increasing_id())
        weights = stage(left.select("ids").mapInArrow(_routes(idf, mean, window), "route long, weight long").groupBy("route").agg(F.sum("weight").alias("weight")), "pack-routes")
        shards = Shards.of(weights.where(F.col("weight") <= shard_tokens), shard_tokens)
        large = stage(weights.where(F.col("weight") > shard_tokens).select("route", F.ceil(F.col("weight") / shard_tokens).alias("parts")), "pack-large", keep=True)
        found = large.count()
    rests = left.mapInArrow(_rests(idf, mean, window, shards), "doc_id long, at long, start long, doc_tokens long, ids binary, route long, shard long")
    if found:
        part = F.pmod(F.xxhash64("at"), F.col("parts"))
        own = LARGE_SHARDS + F.pmod(F.xxhash64("route", part), F.lit(LARGE_SHARDS))
        rests = rests.join(F.broadcast(large) if found <= BROADCAST_ROWS else large, "route", "left").withColumn("shard", F.when(F.col("parts").isNull(), F.col("shard")).otherwise(own)).drop("parts")
    packed = rests.groupBy("shard").applyInArrow(_pack(idf, mean, window, query_terms), PIECES)
    return tokens.where(size >= window).select("doc_id", "ids").mapInArrow(_whole_windows(window), PIECES).unionByName(packed)
