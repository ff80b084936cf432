"""Vector codes by product quantisation, trained by Lloyd's rounds with heaps of slack.

Vectors of whole numbers (``floor(256 * x)``) are cut into 16 parts, each with a codebook of up to 64 entries. A block of
vectors is one row of a staged table: its parts, their entries, and for each part position and entry a
heap of the parts that belong to it. A part's key is its lower bound (distance to the second nearest entry) less its upper
bound (distance to its own), plus the drift that its entry had piled up when the key was made. When the codebooks move, an
entry's drift grows by its own shift and the largest shift of the others, and only parts whose key does not exceed that
drift can have changed their entry: they are popped and measured anew, against all entries, in whole numbers.
All other parts stay unread in their heaps. Sums of parts are kept beside each block, changed by what moved, and added in two levels, so the driver
gets about the square root of the number of tasks of them, each as large as a codebook.

Bounds are floating point and a margin keeps rounding and ties on the safe side; entries, sums, distances and floors are whole numbers.

Defined cases: null vectors and vectors with a null or non-finite component give no row, nor do those with a component beyond
``LARGEST``, whose errors would not fit a long; vectors of each length have codebooks of their own, and a length that 16 does not divide is
filled up with zeros; null ids come after all others and keep their rows; repeated ids and vectors are rows like any other; equal
distances go to the lower entry; fewer than 64 vectors are as many entries; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import scope, ship, spread_join, stage

PARTS, ENTRIES, SCALE = 16, 64, 256
#: Largest component, and rows of a block.
LARGEST, BLOCK = float(1 << 18), 4096
#: Above what rounding can do to a bound (distances stay below 2 ** 32).
MARGIN = 1e-5
BLOCKS = "vec_id array<long>, label array<string>, x binary, code binary, sizes binary, keys binary, members binary, sums binary"
CODED = "vec_id long, label string, code string, error long"


@dataclass
class Codebooks:
    """Entries by part: whole numbers, (PARTS, entries, width). ``drift``: what bounds have lost since the first round."""

    entries: np.ndarray
    drift: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.drift is None:
            self.drift = np.zeros(self.entries.shape[:2])

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries of parts x (n, width), and how much farther the second nearest are."""
        book = self.entries[part]
        step = max(1, (1 << 20) // max(1, book.size))
        code, slack = np.empty(len(x), np.int64), np.full(len(x), np.inf)
        for at in range(0, len(x), step):
            d = ((x[at : at + step, None, :] - book[None]) ** 2).sum(axis=2)
            code[at : at + step] = d.argmin(axis=1)
            if len(book) > 1:
                two = np.sqrt(np.partition(d, 1, axis=1)[:, :2])
                slack[at : at + step] = two[:, 1] - two[:, 0]
        return code, slack

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floored means of their parts; unused ones stay."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        shift = np.sqrt(((new - self.entries).astype(float) ** 2).sum(axis=2))
        others = np.zeros_like(shift)
        if shift.shape[1] > 1:
            two = np.sort(shift, axis=1)[:, -2:]
            first = shift.argmax(axis=1)
            others[:] = two[:, 1:]
            others[np.arange(PARTS), first] = two[:, 0]
        return Codebooks(new, self.drift + shift + others)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Block:
    """Vectors of one block with their entries, heaps and sums."""

    def __init__(self, x: np.ndarray, entries: int):
        self.x = x  # (n, PARTS, width)
        n, _, width = x.shape
        self.code = np.zeros((n, PARTS), np.int64)
        self.heaps: list[list] = [[[] for _ in range(entries)] for _ in range(PARTS)]
        self.sums = np.zeros((PARTS, entries, width + 1), np.int64)  # the last component counts

    @classmethod
    def first(cls, x: np.ndarray, books: Codebooks) -> Block:
        """Every part measured, heaps made."""
        self = cls(x, books.entries.shape[1])
        for p in range(PARTS):
            code, slack = books.nearest(p, x[:, p])
            self.code[:, p] = code
            self._add(p, np.arange(len(x)), code, 1)
            by = np.argsort(code, kind="stable")
            for c, rows in zip(*_grouped(code[by], by), strict=True):
                heap = list(zip(slack[rows].tolist(), rows.tolist(), strict=True))
                heapify(heap)
                self.heaps[p][c] = heap
        return self

    def _add(self, part: int, rows: np.ndarray, code: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part, :, :-1], code, sign * self.x[rows, part])
        np.add.at(self.sums[part, :, -1], code, sign)

    def reassign(self, books: Codebooks) -> int:
        """Pop what the drift has caught up with and measure it anew; the number of parts measured."""
        seen = 0
        for p in range(PARTS):
            caught = []
            for c, heap in enumerate(self.heaps[p]):
                reach = books.drift[p, c] + MARGIN
                if _root(heap) > reach:
                    continue
                heap = self.heaps[p][c] = _unpacked(heap)
                while heap and heap[0][0] <= reach:
                    caught.append(heappop(heap)[1])
            if not caught:
                continue
            rows = np.array(caught)
            seen += len(rows)
            code, slack = books.nearest(p, self.x[rows, p])
            old = self.code[rows, p]
            turned = old != code
            self._add(p, rows[turned], old[turned], -1)
            self._add(p, rows[turned], code[turned], 1)
            self.code[rows, p] = code
            for m, c, key in zip(caught, code.tolist(), (slack + books.drift[p, code]).tolist(), strict=True):
                heap = self.heaps[p][c] = _unpacked(self.heaps[p][c])
                heappush(heap, (key, m))
        return seen

    def errors(self, books: Codebooks) -> np.ndarray:
        own = books.entries[np.arange(PARTS), self.code]
        return ((self.x - own) ** 2).sum(axis=(1, 2))

    def packed(self) -> dict[str, bytes]:
        heaps = [_packed(h) for part in self.heaps for h in part]
        return {
            "x": self.x.astype(np.int32).tobytes(),
            "code": self.code.astype(np.uint8).tobytes(),
            "sizes": np.array([len(k) for k, _ in heaps], np.int32).tobytes(),
            "keys": np.concatenate([k for k, _ in heaps]).tobytes(),
            "members": np.concatenate([m for _, m in heaps]).tobytes(),
            "sums": self.sums.tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict, entries: int, width: int) -> Block:
        self = cls.__new__(cls)
        n = len(row["code"]) // PARTS
        self.x = np.frombuffer(row["x"], np.int32).reshape(n, PARTS, width).astype(np.int64)
        self.code = np.frombuffer(row["code"], np.uint8).reshape(n, PARTS).astype(np.int64)
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(PARTS, entries, width + 1).copy()
        sizes, keys, members = (np.frombuffer(row[k], t) for k, t in (("sizes", np.int32), ("keys", np.float64), ("members", np.int32)))
        ends = np.cumsum(sizes)
        cut = [(keys[e - s : e], members[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
        self.heaps = [cut[p * entries : (p + 1) * entries] for p in range(PARTS)]
        return self


def _grouped(names: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted names and the rows of each."""
    head = np.flatnonzero(np.diff(names, prepend=-1))
    return names[head].tolist(), np.split(rows, head[1:]) if len(head) else []


def _root(heap) -> float:
    """Smallest key of a heap, a list of (key, member) or, as stored, arrays of both."""
    if isinstance(heap, list):
        return heap[0][0] if heap else np.inf
    return heap[0][0] if len(heap[0]) else np.inf


def _unpacked(heap) -> list:
    return heap if isinstance(heap, list) else list(zip(heap[0].tolist(), heap[1].tolist(), strict=True))


def _packed(heap) -> tuple[np.ndarray, np.ndarray]:
    if not isinstance(heap, list):
        return heap
    return np.array([k for k, _ in heap], np.float64), np.array([m for _, m in heap], np.int32)


def whole_parts(vectors: np.ndarray) -> np.ndarray:
    """(n, d) numbers -> (n, PARTS, width) whole numbers, filled up with zeros."""
    n, d = vectors.shape
    width = -(-d // PARTS)
    out = np.zeros((n, PARTS * width), np.int64)
    out[:, :d] = np.floor(SCALE * vectors)
    return out.reshape(n, PARTS, width)


def _row(ids: pa.Array, labels: pa.Array, block: Block) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    binary = block.packed()
    return pa.RecordBatch.from_arrays([one(ids), one(labels), *(pa.array([v], pa.binary()) for v in binary.values())], names=["vec_id", "label", *binary])


def _first(books: Codebooks, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                own = b.slice(at, BLOCK)
                x = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, d)
                yield _row(own.column(0), own.column(1), Block.first(whole_parts(x), books))

    return run


def _again(books: Codebooks, coded: bool):
    """The next assignment of staged blocks: as blocks, or at last as codes and errors."""
    _, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names) if k > 1}
                block = Block.unpacked(row, entries, width)
                block.reassign(books)
                ids, labels = b.column(0)[i].values, b.column(1)[i].values
                if coded:
                    codes = [c.tobytes().hex() for c in block.code.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(block.errors(books), pa.int64())], names=["vec_id", "label", "code", "error"])
                else:
                    yield _row(ids, labels, block)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for v in b.column(0):
            x = np.frombuffer(v.as_buffer(), np.int64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])


def _summed(blocks: DataFrame, books: Codebooks) -> Codebooks:
    parts = blocks.select(F.col("sums").alias("v")).mapInArrow(_added, "v binary")
    few = parts.repartition(max(1, round(parts.rdd.getNumPartitions() ** 0.5))).mapInArrow(_added, "v binary").collect()
    _, entries, width = books.entries.shape
    sums = sum(np.frombuffer(r["v"], np.int64) for r in few).reshape(PARTS, entries, width + 1)
    return books.moved(sums[..., :-1], sums[..., -1])


def _of_length(rows: DataFrame, d: int, rounds: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of rows (vec_id, label, e) with vectors of d components."""
    own = rows.where(F.size("e") == d)
    start = own.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(ENTRIES).select("e").collect()
    first = whole_parts(np.array([r["e"] for r in start], float).reshape(len(start), d))
    books = Codebooks(first.transpose(1, 0, 2).copy())
    blocks = stage(own.mapInArrow(_first(books, d), BLOCKS), "lloyd-first")
    for r in range(rounds):
        books = _summed(blocks, books)
        if r < rounds - 1:
            blocks = stage(blocks.mapInArrow(_again(books, False), BLOCKS), "lloyd-blocks")
    return blocks.mapInArrow(_again(books, True), CODED).withColumn("codebooks_sha256", F.lit(books.digest()))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    if rounds < 1:
        raise ValueError("a round is needed")
    spark = vectors.sparkSession
    ship(spark)
    e = F.col(vector_col).cast("array<double>")
    fits = F.forall("e", lambda x: F.abs(x) <= LARGEST)  # unknown for null, false for what is not a number
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), e.alias("e")).where(fits)
    with scope(spark):
        lengths = sorted(r["d"] for r in rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect())
        coded = spark.createDataFrame([], CODED + ", codebooks_sha256 string")
        for d in lengths:
            coded = coded.unionByName(_of_length(rows, d, rounds))
        coded = stage(coded.withColumn("name", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "lloyd-codes", keep=True)
    known = coded.groupBy("name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return spread_join(coded, known, "name", "n", coded.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
