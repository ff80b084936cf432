"""k-means: parallel seeding, and Lloyd's rounds with bounds kept beside the rows.

Centres are k x d numbers and go to every task; tasks send back sums by centre, added in two levels. With ``bounds`` rows are staged in
blocks that hold, beside each row, its centre, an upper bound of the distance to it and a lower bound of the distance to any
other (Hamerly). When centres move the bounds give way by as much, and only rows whose bounds have met are measured again; a block
in which none have is not measured at all. Without bounds a round is one scan.

Seeding in parallel (k-means||): from one row on, each of a few scans takes every row with a probability that grows with its
squared distance to what has been taken, about ``2 * k`` rows a scan; one more scan counts the rows near each, and the
weighted candidates are reduced to k on the driver. Draws are hashes of the rows, so they repeat on any partitioning.

Defined cases: rows with a missing value are left out of fits and have a null label; ties go to the lower centre; an empty cluster
keeps its centre; fewer rows than clusters raise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.blocks import CELLS, Vectors, folded, matrix, tree_merged, vector, whole
from gridloom.sources.package import ship
from gridloom.sources.scratch import staged

#: Clusters from which bounds pay for the blocks that are written, and rows of a block.
BOUNDED_FROM, BLOCK = 16, 4096
BLOCKS = "x binary, label binary, upper binary, lower binary, sums binary, measured long"
#: Share by which bounds must be apart, above what rounding can do.
MARGIN = 1e-9


def squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centres), from differences."""
    out = np.empty((len(x), len(centers)))
    step = max(1, CELLS // max(1, centers.size))
    for at in range(0, len(x), step):
        out[at : at + step] = ((x[at : at + step, None, :] - centers[None]) ** 2).sum(axis=2)
    return out


def sums_by(label: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """(k, d + 1): sums of rows by label, and their number."""
    out = np.zeros((k, x.shape[1] + 1))
    np.add.at(out[:, :-1], label, x)
    out[:, -1] = np.bincount(label, minlength=k)
    return out


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


class Bounded:
    """A block of rows with their bounds."""

    def __init__(self, x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.x, self.label, self.upper, self.lower = x, label, upper, lower

    @classmethod
    def first(cls, x: np.ndarray, centers: np.ndarray) -> Bounded:
        self = cls(x, np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x)))
        self._measure(np.arange(len(x)), centers)
        return self

    def _measure(self, rows: np.ndarray, centers: np.ndarray) -> None:
        d = np.sqrt(squares(self.x[rows], centers))
        self.label[rows] = at = d.argmin(axis=1)
        here = np.arange(len(rows))
        self.upper[rows] = d[here, at]
        d[here, at] = np.inf
        self.lower[rows] = d.min(axis=1)

    def moved(self, before: np.ndarray, centers: np.ndarray) -> int:
        """Bounds after the centres have moved; the number of rows that had to be measured against all of them."""
        shift = np.sqrt(((centers - before) ** 2).sum(axis=1))
        self.upper += shift[self.label]
        if len(centers) == 1:
            return 0
        two = np.argsort(shift)[-2:]
        self.lower -= np.where(self.label == two[1], shift[two[0]], shift[two[1]])
        apart = np.sqrt(squares(centers, centers))
        np.fill_diagonal(apart, np.inf)
        reach = np.maximum(self.lower, apart.min(axis=1)[self.label] / 2)
        met = np.flatnonzero(self.upper * (1 + MARGIN) + 1e-12 >= reach)
        own = np.sqrt(((self.x[met] - centers[self.label[met]]) ** 2).sum(axis=1))
        self.upper[met] = own
        rows = met[own * (1 + MARGIN) + 1e-12 >= reach[met]]
        if len(rows):
            self._measure(rows, centers)
        return len(rows)

    def batch(self, k: int, measured: int) -> pa.RecordBatch:
        cells = [self.x, self.label, self.upper, self.lower, sums_by(self.label, self.x, k)]
        return pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in cells), pa.array([measured], pa.int64())], names=["x", "label", "upper", "lower", "sums", "measured"])


def _first_blocks(centers: np.ndarray):
    k, d = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0), d)
            for at in range(0, len(x), BLOCK):
                own = x[at : at + BLOCK].copy()
                yield Bounded.first(own, centers).batch(k, len(own))

    return run


def _next_blocks(before: np.ndarray, centers: np.ndarray):
    k, d = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, label, upper, lower = (np.frombuffer(b.column(c)[r].as_buffer(), t).copy() for c, t in enumerate((np.float64, np.int32, np.float64, np.float64)))
                block = Bounded(x.reshape(-1, d), label, upper, lower)
                measured = block.moved(before, centers)
                yield block.batch(k, measured)

    return run


def _labelled(centers: np.ndarray, name: str, d: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(columns)
            known = np.asarray(vectors.is_valid())
            label = np.zeros(b.num_rows, np.int32)
            if known.any():
                label[known] = squares(matrix(vectors.filter(pa.array(known)), d), centers).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(label, mask=~known)], names=[*b.schema.names[:columns], name])

    return run


def _drawn(candidates: np.ndarray, factor: float):
    """Rows whose draw is below their probability: (draw, x) in, x out."""
    d = candidates.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, x = b.column(0).to_numpy(), matrix(b.column(1), d)
            taken = u < factor * squares(x, candidates).min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(taken))], names=["x"])

    return run


def reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """k centres of weighted points: weighted draws far from each other, then weighted rounds."""
    rng = np.random.default_rng(seed)
    centers = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centers) < k:
        far = squares(points, centers).min(axis=1) * weights
        chosen = rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else int(rng.integers(len(points)))
        centers = np.vstack((centers, points[chosen]))
    for _ in range(rounds):
        at = squares(points, centers).argmin(axis=1)
        mass = np.bincount(at, weights, k)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, points * weights[:, None])
        centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centers)
    return centers


@dataclass
class KMeans:
    """Squared Euclidean k-means; ties go to the lower centre, an empty cluster keeps its centre.

    ``init``: "hash" takes the k rows with the smallest seeded hashes, "parallel" seeds by k-means||. ``bounds``: None
    keeps bounds from BOUNDED_FROM clusters on. ``measured`` has, for every round, the rows that were compared with all centres.
    """

    columns: Sequence[str] | Vectors
    k: int = 8
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    centers: np.ndarray | None = None
    init: str = "hash"
    init_rounds: int = 5
    bounds: bool | None = None
    scans: int = 0
    measured: list[int] = field(default_factory=list)

    def _rows(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        return df.where(whole(self.columns)).select(vector(self.columns).alias("x"))

    def _initial(self, rows: DataFrame) -> np.ndarray:
        """The same for the same data, however they are partitioned."""
        if self.init not in ("hash", "parallel"):
            raise ValueError("init must be hash or parallel")
        first = rows.orderBy(F.xxhash64(F.lit(self.seed), "x"), "x").limit(self.k).collect()
        self.scans += 1
        if len(first) < self.k:
            raise ValueError("fewer rows than clusters")
        start = np.array([list(r["x"]) for r in first], float)
        return start if self.init == "hash" else self._parallel(rows, start[:1])

    def _parallel(self, rows: DataFrame, candidates: np.ndarray) -> np.ndarray:
        d = len(self.columns)
        for r in range(self.init_rounds):
            cost = self._cost(rows, candidates)
            if cost <= 0:
                break
            # 53 bits of a hash; copies of a row are drawn together and are one candidate
            draw = (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(r + 1), "x"), 11).cast("double") / float(1 << 53)).alias("u")
            taken = rows.select(draw, "x").mapInArrow(_drawn(candidates, 2 * self.k / cost), "x array<double>").distinct().collect()
            self.scans += 1
            if taken:
                candidates = np.unique(np.vstack((candidates, np.array([list(t["x"]) for t in taken], float))), axis=0)
        step = lambda s, x, c=candidates: np.bincount(squares(x, c).argmin(axis=1), minlength=len(c)).astype(float) + (0 if s is None else s)
        weights = folded(rows, F.col("x"), d, step, _added)
        self.scans += 1
        return reduced(candidates, weights, self.k, self.seed)

    def _cost(self, rows: DataFrame, centers: np.ndarray) -> float:
        step = lambda s, x, c=centers: np.array([squares(x, c).min(axis=1).sum()]) + (0 if s is None else s)
        got = folded(rows, F.col("x"), len(self.columns), step, _added)
        self.scans += 1
        return 0.0 if got is None else float(got[0])

    def _moved(self, sums: np.ndarray | None) -> float:
        """Centres at their rows' means; how far they went."""
        if sums is None:
            return 0.0
        sums = sums.reshape(self.k, -1)
        new = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), self.centers)
        shift = float(np.sqrt(((new - self.centers) ** 2).sum()))
        self.centers = new
        return shift

    def _plain_round(self, rows: DataFrame) -> float:
        k, centers = self.k, self.centers

        def step(s: np.ndarray | None, x: np.ndarray) -> np.ndarray:
            sums = sums_by(squares(x, centers).argmin(axis=1), x, k).ravel()
            return sums if s is None else s + sums

        self.scans += 1
        return self._moved(folded(rows, F.col("x"), len(self.columns), step, _added))

    def _bounded_rounds(self, rows: DataFrame) -> None:
        blocks, before = None, None
        for _ in range(self.max_iter):
            made = rows.mapInArrow(_first_blocks(self.centers), BLOCKS) if blocks is None else blocks.mapInArrow(_next_blocks(before, self.centers), BLOCKS)
            blocks = staged(made, "kmeans-blocks")
            self.scans += 1
            self.measured.append(int(blocks.agg(F.coalesce(F.sum("measured"), F.lit(0))).first()[0]))
            before = self.centers
            if self._moved(tree_merged(blocks.select(F.col("sums").alias("v")), _added)) < self.tol:
                break

    def fit(self, df: DataFrame, initial: np.ndarray | None = None) -> KMeans:
        self.scans, self.measured = 0, []
        rows = self._rows(df).persist()
        try:
            self.centers = np.array(initial, float) if initial is not None else self._initial(rows)
            if self.k >= BOUNDED_FROM if self.bounds is None else self.bounds:
                self._bounded_rounds(rows)
            else:
                for _ in range(self.max_iter):
                    if self._plain_round(rows) < self.tol:
                        break
        finally:
            rows.unpersist()
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.centers is None:
            raise RuntimeError("fit the model first")
        ship(df.sparkSession)
        own = [c for c in df.columns if c != name]
        schema = T.StructType([*[df.schema[c] for c in own], T.StructField(name, T.IntegerType())])
        vectors = F.when(whole(self.columns), vector(self.columns)).alias("__x")
        return df.select(*own, vectors).mapInArrow(_labelled(self.centers, name, len(self.columns), len(own)), schema)

    def fit_predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.fit(df).predict(df, name)

    def inertia(self, df: DataFrame) -> DataFrame:
        """One row with the sum of squared distances to the nearest centres as ``v``."""
        if self.centers is None:
            raise RuntimeError("fit the model first")
        return df.sparkSession.createDataFrame([(self._cost(self._rows(df), self.centers),)], "v double")
