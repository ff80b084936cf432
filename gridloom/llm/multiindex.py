"""Approximate nearest neighbours: an inverted multi-index.

Vectors are cut in two halves, each quantised by its own k-means codebook (fitted on
a bounded sample, ``sample`` rows with the smallest id hashes); a pair of centroids
is a cell, and every vector is in one. Cells' sizes are counted over all rows. A query
walks the grid of centroid pairs by growing sum of its two squared distances with a
heap, until the cells passed hold ``share`` of all vectors, and reranks their entries
by exact distance in double precision. The share is the same at every size; below that many in all, the walk goes on to
``least`` vectors, so small tables are searched whole. Vectors of each length have an index of their own.

Each query is walked once. Neighbouring cells share a shard of about ``shard_rows``
entries, and a cell that holds more (a third of all rows, say) is dealt over shards of
its own; a query is sent, with the cells it asks for, to the shards that hold them and
to no others. A task reads a shard's entries, then its queries batch by batch, and
returns the k best of each; the best of those are ranked. Entries move once, whatever the number of
queries. What is broadcast is bounded: two codebooks and numbers for at most ``centroids`` squared cells.

Defined cases: null, empty, zero or non-finite vectors take no part, as queries or candidates; vectors of unlike
lengths have no distance, so each is searched among those of its own; distances that tie go to the smaller
id; null ids take no part; with fewer candidates than asked for, all are returned; an
empty table gives an empty result. A row is a candidate for all rows but itself, also
for rows that repeat its id. Every row with a query's id is asked and has a list of its
own, so a repeated query row gives its ranks as often as it stands in the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import scope, ship, stage
from gridloom.llm.crosspolytope import usable

RESULT = "query_row long, query_id long, vec_id long, score double"
DEALT = "shard int, asks boolean, row long, vec_id long, cell int, cells binary, embedding array<double>"
#: Rough distances that a task holds at once.
ROUGH = 1 << 22


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids; a centroid without points keeps its place."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


@dataclass
class MultiIndex:
    """Two codebooks and, once counted, the cells' sizes."""

    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray | None = None

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.left) * len(self.right) + nearest(x[:, self.half :], self.right)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((self.left - q[: self.half]) ** 2).sum(1), ((self.right - q[self.half :]) ** 2).sum(1)

    def traverse(self, q: np.ndarray, enough: float) -> np.ndarray:
        """Cells by growing summed distance until they hold enough vectors (multi-sequence walk)."""
        a, b = self.distances(q)
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i_order].tolist(), b[j_order].tolist()
        grid = self.sizes.reshape(len(a), len(b))[np.ix_(i_order, j_order)].tolist()
        names = (i_order[:, None] * len(b) + j_order[None, :]).tolist()
        heap, done, held = [(a[0] + b[0], 0, 0)], [-1] * len(a), 0
        out = []
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            done[i] = j
            if grid[i][j]:
                out.append(names[i][j])
                held += grid[i][j]
            # a neighbour enters once both cells before it have been passed
            if i + 1 < len(a) and (j == 0 or done[i + 1] == j - 1):
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or done[i - 1] > j):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return np.array(out, dtype=np.int64)


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _assign(index: MultiIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = index.cells(_matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.astype(np.int32)), b.column(2)], names=["row", "vec_id", "cell", "embedding"])

    return run


@dataclass
class Shards:
    """Which shards hold a cell: ``parts`` of them from ``first`` on."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, rows: int) -> Shards:
        first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        shard, held = 0, 0
        for cell, n in enumerate(sizes.tolist()):
            if held and held + n > rows:
                shard, held = shard + 1, 0
            first[cell], parts[cell] = shard, max(1, -(-n // rows))
            held += n
            if n > rows:
                shard, held = shard + int(parts[cell]), 0
        return cls(first, parts)

    @property
    def count(self) -> int:
        return int((self.first + self.parts).max())


def _dealt(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "asks": pa.bool_(), "row": pa.int64(), "vec_id": pa.int64(), "cell": pa.int32(), "cells": pa.binary(), "embedding": pa.list_(pa.float64())}
    have, n = dict(zip(names, columns, strict=True)), len(columns[0])
    return pa.RecordBatch.from_arrays([have[c].cast(t) if c in have else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def _deal_entries(shards: Shards):
    """Entries with their shard; those of a cut cell take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            cell = b.column(2).to_numpy()
            shard = shards.first[cell] + (at + np.arange(len(cell))) % shards.parts[cell]
            at += len(cell)
            yield _dealt(["shard", "asks", "row", "vec_id", "cell", "embedding"], [pa.array(shard), pa.array(np.zeros(len(cell), bool)), *b.columns])

    return run


def _deal_queries(index: MultiIndex, shards: Shards, enough: float):
    """A query's copies, one for each shard that holds a cell which its walk passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (row, q) in enumerate(zip(b.column(0).to_pylist(), _matrix(b.column(3)), strict=True)):
                cells = np.sort(index.traverse(q, enough))
                first, parts = shards.first[cells], shards.parts[cells]
                held = np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                order = np.argsort(held, kind="stable")
                held, asked = held[order], np.repeat(cells, parts)[order].astype("<i4")
                cut = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
                n = len(cut)
                same = pa.array(np.full(n, i))
                yield _dealt(
                    ["shard", "asks", "row", "vec_id", "cells", "embedding"],
                    [pa.array(held[cut]), pa.array(np.ones(n, bool)), pa.array(np.full(n, row)), b.column(1).take(same), pa.array([x.tobytes() for x in np.split(asked, cut[1:])], pa.binary()), b.column(3).take(same)],
                )

    return run


class _Shard:
    """Entries of one shard as inverted lists."""

    def __init__(self, parts: list[pa.RecordBatch]):
        entries = pa.Table.from_batches(parts)
        order = np.lexsort((entries["vec_id"].to_numpy(), entries["cell"].to_numpy()))
        self.cell, self.rows, self.ids = (entries[c].to_numpy()[order] for c in ("cell", "row", "vec_id"))
        self.x = np.concatenate([_matrix(p.column("embedding")) for p in parts])[order]
        self.norms = (self.x * self.x).sum(1)

    def nearest(self, queries: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, id, entries' ids, distances) of each query's k best in the cells it asks for."""
        q = _matrix(queries.column("embedding"))
        step = max(1, ROUGH // max(1, len(self.ids)))
        rows, ids, cells = (queries.column(c).to_pylist() for c in ("row", "vec_id", "cells"))
        for start in range(0, len(q), step):
            rough = self.norms[:, None] - 2 * self.x @ q[start : start + step].T
            for j in range(rough.shape[1]):
                i = start + j
                asked = np.frombuffer(cells[i], "<i4")
                lo, hi = np.searchsorted(self.cell, asked), np.searchsorted(self.cell, asked, "right")
                at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
                at = at[self.rows[at] != rows[i]]
                if len(at) > 4 * k:  # a wide margin around the k best, then exactly
                    near = rough[at, j]
                    cut = np.partition(near, 2 * k)[2 * k]
                    at = at[near <= cut + 1e-9 * (1 + abs(cut) + float(q[i] @ q[i]))]
                d = np.sqrt(((self.x[at] - q[i]) ** 2).sum(1))
                best = np.lexsort((self.ids[at], d))[:k]
                yield rows[i], ids[i], self.ids[at[best]], d[best]


def _search(k: int):
    """Rows sorted by shard, entries before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for b in batches:
            place = np.stack((b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)))
            cuts = np.flatnonzero(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0)))
            for at, to in zip(cuts, np.append(cuts[1:], b.num_rows), strict=True):
                if key != place[0, at]:
                    key, parts, shard = place[0, at], [], None
                piece = b.slice(at, to - at)
                if not place[1, at]:
                    parts.append(piece)
                    continue
                if shard is None and parts:
                    shard, parts = _Shard(parts), []
                found = list(shard.nearest(piece, k)) if shard else []
                sizes = [len(f[2]) for f in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], sizes)), pa.array(np.repeat([f[1] for f in found], sizes)), pa.array(np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[3] for f in found]))],
                        names=["query_row", "query_id", "vec_id", "score"],
                    )

    return run


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of every vector that takes part."""
    return vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))


def build(own: DataFrame, centroids: int = 256, sample: int = 10_000) -> tuple[DataFrame, MultiIndex]:
    """Staged (row, vec_id, cell, embedding) of vectors of one length, and the index."""
    own = own.withColumn("embedding", F.when(F.size("embedding") == 1, F.array_append("embedding", F.lit(0.0))).otherwise(F.col("embedding")))  # two halves
    rows = own.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).collect()
    x = np.array([r["embedding"] for r in rows])
    half = x.shape[1] // 2
    index = MultiIndex(kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids, seed=6))
    numbered = own.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    entries = stage(numbered.mapInArrow(_assign(index), "row long, vec_id long, cell int, embedding array<double>"), "imi-entries")
    index.sizes = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most centroids squared rows
        index.sizes[r["cell"]] = r["count"]
    return entries, index


def _search_length(own: DataFrame, every: int, k: int, share: float, least: int, shard_rows: int) -> DataFrame:
    entries, index = build(own)
    n = int(index.sizes.sum())
    tasks = 2 * own.sparkSession.sparkContext.defaultParallelism
    shards = Shards.of(index.sizes, min(shard_rows, max(1, -(-n // tasks))))
    asked = entries.where(F.col("vec_id") % every == 0)
    routed = asked.repartition(tasks, "row").mapInArrow(_deal_queries(index, shards, max(share * n, least, k + 1)), DEALT)
    dealt = entries.mapInArrow(_deal_entries(shards), DEALT)
    met = dealt.union(routed).repartition(min(shards.count, 20 * tasks), "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(_search(k), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    k: int = 10,
    share: float = 0.33,
    least: int = 500,
    shard_rows: int = 250_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    own = usable_vectors(vectors, id_col, vector_col)
    with scope(spark):
        best = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        for r in own.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
            best = best.unionByName(_search_length(own.where(F.size("embedding") == r["d"]), every, k, share, least, shard_rows))
        return stage(best, "imi-found", keep=True)
