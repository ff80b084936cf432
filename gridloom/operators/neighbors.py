"""k nearest neighbours, exactly, by Voronoi cells round pivots.

Training rows go to the cell of their nearest pivot (a bounded sample of rows). Of each cell its size, its radius and its k
smallest distances to the pivot are known. They bound how far a query's k-th neighbour can be: by the triangle inequality a row lies no farther
than the query's distance to a pivot and the row's own. A query is sent only to cells that can hold anything nearer:
neither the cell's radius, nor its inner radius, nor the plane half way to the query's own pivot may keep it out.
A cell of many rows is dealt over several units. A task holds one unit's rows, reads its queries batch by batch and
keeps the k best of each, so no pair of rows is ever listed or sorted; the best of a query's units are ranked at the end.
What a Python worker holds is bounded, however many rows there are: the pivots, a unit, ROUGH distances and SENT cells of copies.

Defined cases: training rows with a missing coordinate take no part and rows that ask with one have no neighbours (a null
prediction); equal distances go to the smaller training key; fewer training rows than k are all neighbours; rows that repeat
a key and its coordinates ask once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import metrics
from gridloom.operators.blocks import State, Vectors, matrix, state_batch, tree_merged, vector, whole
from gridloom.sources.package import ship
from gridloom.sources.scratch import staged

#: Distances that a task holds at once.
ROUGH = 1 << 22
#: Cells of the copies of queries that are passed on at once.
SENT = 1 << 20


@dataclass
class Cells:
    """Pivots and what is known of their cells: sizes, radii, inner radii and smallest distances, ascending."""

    pivots: np.ndarray
    sizes: np.ndarray
    outer: np.ndarray
    inner: np.ndarray
    least: np.ndarray
    first: np.ndarray
    units: np.ndarray

    def visited(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells): whether the cell can hold one of the query's k nearest."""
        d = _distances(q, self.pivots)
        k = self.least.shape[1]
        reach = (d[:, :, None] + self.least).reshape(len(q), -1)
        theta = np.partition(reach, k - 1, axis=1)[:, k - 1]
        theta = np.where(np.isfinite(theta), theta * (1 + 1e-9) + 1e-9, np.inf)[:, None]  # fewer than k rows: all of them
        own = d.argmin(axis=1)
        apart = _distances(self.pivots, self.pivots)[own]
        plane = np.where(apart > 0, (d * d - (d[np.arange(len(q)), own] ** 2)[:, None]) / (2 * np.where(apart > 0, apart, 1)), 0.0)
        slack = 1e-9 * (1 + d)
        return (self.sizes > 0) & (d - self.outer <= theta + slack) & (self.inner - d <= theta + slack) & (plane <= theta + slack * (1 + d))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    step = max(1, ROUGH // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.sqrt(((x[at : at + step, None, :] - y[None]) ** 2).sum(axis=2))
    return out


def _dealt(cells_pivots: np.ndarray):
    """Rows with their nearest pivot and the distance to it."""
    d = cells_pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = _distances(matrix(b.column(2), d), cells_pivots)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], names=[*b.schema.names, "__cell", "__far"])

    return run


def _cells_merged(k: int):
    """States hold for each cell: size, radius, inner radius and the k smallest distances."""

    def merge(a: State, b: State) -> State:
        a, b = a.reshape(-1, k + 3), b.reshape(-1, k + 3)
        least = np.sort(np.concatenate((a[:, 3:], b[:, 3:]), axis=1), axis=1)[:, :k]
        return np.column_stack((a[:, 0] + b[:, 0], np.maximum(a[:, 1], b[:, 1]), np.minimum(a[:, 2], b[:, 2]), least)).ravel()

    return merge


def _cells_of(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.full((n, k + 3), np.inf)
        state[:, :2] = 0
        for b in batches:
            cell, far = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((far, cell))
            cell, far = cell[order], far[order]
            head = np.flatnonzero(np.diff(cell, prepend=-1))
            count = np.diff(np.append(head, len(cell)))
            seen = cell[head]
            state[seen, 0] += count
            state[seen, 1] = np.maximum(state[seen, 1], np.maximum.reduceat(far, head) if len(head) else 0)
            state[seen, 2] = np.minimum(state[seen, 2], far[head])
            for c, at, m in zip(seen, head, count, strict=True):
                state[c, 3:] = np.sort(np.concatenate((state[c, 3:], far[at : at + min(m, k)])))[:k]
        yield state_batch(state.ravel())

    return run


def _sent(cells: Cells, queries: bool):
    """Training rows with their unit, and queries once for each unit that they are sent to."""
    d = cells.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            if not queries:
                cell = b.column(3).to_numpy()
                unit = cells.first[cell] + (turn + np.arange(len(cell))) % cells.units[cell]
                turn += len(cell)
                yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), b.column(0), b.column(1), b.column(2)], names=["__u", "__t", "__y", "__x"])
                continue
            step = max(1, ROUGH // max(1, cells.least.size))
            for at in range(0, b.num_rows, step):
                own = b.slice(at, step)
                row, cell = np.nonzero(cells.visited(matrix(own.column(1), d)))
                units = cells.units[cell]
                row = np.repeat(row, units)
                ends = np.cumsum(units)
                unit = np.repeat(cells.first[cell] - (ends - units), units) + np.arange(ends[-1] if len(ends) else 0)
                many = max(1, SENT // max(1, d))  # a query has a copy for each unit, so copies are made a few at a time
                for lo in range(0, len(row), many):
                    take = pa.array(row[lo : lo + many])
                    yield pa.RecordBatch.from_arrays([pa.array(unit[lo : lo + many].astype(np.int32)), own.column(0).take(take), own.column(1).take(take)], names=["__u", "__q", "__x"])

    return run


def _nearest(k: int, d: int):
    """Rows sorted by unit, training rows before queries and by key: each query's k best of the unit."""

    def best(x: np.ndarray, norms: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, ROUGH // len(x))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            squares = (some * some).sum(axis=1)
            rough = norms[:, None] - 2 * x @ some.T + squares
            for j in range(len(some)):
                near = np.arange(len(x))
                if len(x) > 4 * k:
                    cut = np.partition(rough[:, j], k - 1)[k - 1]
                    near = np.flatnonzero(rough[:, j] <= cut + 1e-9 * (1 + squares[j] + norms.max()))
                far = ((x[near] - some[j]) ** 2).sum(axis=1)
                top = np.lexsort((near, far))[:k]
                yield near[top], far[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, held = None, [], None
        for b in batches:
            u, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (asks[1:] != asks[:-1])))
            for at, to in zip(cuts, np.append(cuts[1:], len(u)), strict=True):
                if unit != u[at]:
                    unit, parts, held = u[at], [], None
                piece = b.slice(at, to - at)
                if not asks[at]:
                    parts.append(piece)
                    continue
                if held is None and parts:
                    rows = pa.Table.from_batches(parts).select(["__t", "__y"]).combine_chunks()
                    x = np.concatenate([matrix(p.column(5), d) for p in parts])
                    held, parts = (rows, x, (x * x).sum(axis=1)), []
                if held is None:
                    continue
                rows, x, norms = held
                found = list(best(x, norms, matrix(piece.column(5), d)))
                chosen = rows.take(pa.array(np.concatenate([f[0] for f in found])))
                asked = piece.column(4).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                yield pa.RecordBatch.from_arrays(
                    [asked, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in chosen.columns), pa.array(np.concatenate([f[1] for f in found]))], names=["__q", "__t", "__y", "__d"]
                )

    return run


@dataclass
class _Neighbors:
    columns: Sequence[str] | Vectors
    target: str
    key: str
    k: int = 5
    #: Most pivots, and training rows of a unit.
    pivots: int = 256
    unit_rows: int = 50_000
    train: DataFrame | None = None
    cells: Cells | None = None

    def fit(self, df: DataFrame):
        if self.k < 1:
            raise ValueError("k must be positive")
        ship(df.sparkSession)
        own = df.where(whole(self.columns)).select(F.col(self.key).alias("__t"), F.col(self.target).alias("__y"), vector(self.columns).alias("__x"))
        n = own.count()
        wanted = min(self.pivots, max(1, round(n**0.5)))
        chosen = own.orderBy(F.xxhash64("__t"), "__t", "__x").limit(wanted).select("__x").collect()  # at most ``pivots`` rows
        points = np.unique(np.array([r["__x"] for r in chosen], float).reshape(len(chosen), len(self.columns)), axis=0)
        if not len(points):
            points = np.zeros((1, len(self.columns)))
        schema = T.StructType([*own.schema.fields, T.StructField("__cell", T.IntegerType()), T.StructField("__far", T.DoubleType())])
        self.train = staged(own.mapInArrow(_dealt(points), schema), "knn-cells")
        state = tree_merged(self.train.select("__cell", "__far").mapInArrow(_cells_of(len(points), self.k), "v binary"), _cells_merged(self.k))
        state = np.zeros((len(points), self.k + 3)) if state is None else state.reshape(len(points), self.k + 3)
        sizes = state[:, 0].astype(np.int64)
        units = np.maximum(1, -(-sizes // self.unit_rows))
        self.cells = Cells(points, sizes, state[:, 1], state[:, 2], state[:, 3:], np.cumsum(units) - units, units)
        return self

    def neighbors(self, df: DataFrame) -> DataFrame:
        """(__q, __t, __y, __d, __r): the k nearest training rows of each query by squared distance, ties by training key."""
        if self.train is None or self.cells is None:
            raise RuntimeError("fit the model first")
        train, cells = self.train.schema, self.cells
        asked = df.where(whole(self.columns)).select(F.col(self.key).alias("__q"), vector(self.columns).alias("__x")).distinct()
        kinds = {"__u": "int", "__t": train["__t"].dataType, "__y": train["__y"].dataType, "__q": asked.schema["__q"].dataType, "__x": "array<double>"}
        made = lambda *names: T.StructType([T.StructField(n, T.IntegerType() if n == "__u" else T.ArrayType(T.DoubleType()) if n == "__x" else kinds[n]) for n in names])
        rows = self.train.mapInArrow(_sent(cells, False), made("__u", "__t", "__y", "__x")).select("__u", F.lit(False).alias("__asks"), "__t", "__y", F.lit(None).cast(kinds["__q"]).alias("__q"), "__x")
        sent = asked.mapInArrow(_sent(cells, True), made("__u", "__q", "__x")).select("__u", F.lit(True).alias("__asks"), F.lit(None).cast(kinds["__t"]).alias("__t"), F.lit(None).cast(kinds["__y"]).alias("__y"), "__q", "__x")
        tasks = min(int(cells.units.sum()), 20 * df.sparkSession.sparkContext.defaultParallelism)
        met = rows.unionByName(sent).repartition(max(1, tasks), "__u").sortWithinPartitions("__u", "__asks", "__t")
        schema = T.StructType([*made("__q", "__t", "__y").fields, T.StructField("__d", T.DoubleType())])
        near = met.mapInArrow(_nearest(self.k, len(self.columns)), schema)
        w = Window.partitionBy("__q").orderBy("__d", "__t")  # k rows a unit
        return near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= self.k)


@dataclass
class KNeighborsClassifier(_Neighbors):
    """Majority of the k nearest; ties go to the smaller class."""

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        votes = self.neighbors(df).groupBy("__q", "__y").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("__q").alias(self.key)).agg(F.min_by("__y", F.struct(-F.col("n"), F.col("__y"))).alias(name))
        return df.join(best, self.key, "left")

    def score(self, df: DataFrame) -> DataFrame:
        return self.predict(df, "__p").agg(metrics.accuracy(F.col(self.target), F.col("__p")).alias("v"))


@dataclass
class KNeighborsRegressor(_Neighbors):
    """Mean target of the k nearest."""

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        best = self.neighbors(df).groupBy(F.col("__q").alias(self.key)).agg(F.avg("__y").alias(name))
        return df.join(best, self.key, "left")

    def score(self, df: DataFrame) -> DataFrame:
        return self.predict(df, "__p").agg(metrics.r2(F.col(self.target), F.col("__p")).alias("v"))
