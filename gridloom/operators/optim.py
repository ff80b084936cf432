"""First-order minimisers. Callbacks map parameters to numbers, usually by one Spark aggregate each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blocks import matrix, state_batch, tree_merged, vector, whole
from gridloom.sources.package import ship
from gridloom.sources.scratch import dropped, staged

Cost = Callable[[np.ndarray], float]
Gradient = Callable[[np.ndarray], np.ndarray]


@dataclass
class GradientDescent:
    """Steps against the gradient until they are shorter than tol."""

    lr: float = 0.01
    max_iter: int = 1000
    tol: float = 1e-6

    def minimize(self, cost: Cost, gradient: Gradient, start: Sequence[float]) -> np.ndarray:
        x = np.array(start, float)
        for _ in range(self.max_iter):
            step = self.lr * np.asarray(gradient(x), float)
            x = x - step
            if np.linalg.norm(step) < self.tol:
                break
        return x


@dataclass
class StochasticGradientDescent:
    """Passes over batches of about ``batch_size`` rows; a batch is the rows whose key falls into its residue class.

    Rows are laid out once: batches lie one after another in the partitions of a staged table, each whole in one of them.
    A pass is one scan: every task walks its batches from the model that the pass began with, and the models of the tasks are averaged by their
    rows, in two levels. With one worker the batches follow each other as on one machine.

    Batches of more than ``piece_rows`` rows are in no task as a whole: a step is a job of all tasks over the batch, which take its gradient in pieces and
    average the pieces by rows. So the gradient must be a mean over rows there.
    """

    lr: float = 0.01
    max_iter: int = 100
    batch_size: int = 32
    tol: float = 1e-6
    #: Tasks that walk batches side by side.
    workers: int = 1
    #: Rows of a batch that a task takes at once.
    piece_rows: int = 1 << 16
    scans: int = 0

    def minimize(self, data: DataFrame, key: str, columns: Sequence[str], gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], start: Sequence[float]) -> np.ndarray:
        """gradient(rows, x): the gradient at x over a batch's rows, an array with the columns in order. Rows with a missing value are left out."""
        if self.batch_size < 1 or self.workers < 1:
            raise ValueError("a batch needs a row, and a pass a worker")
        ship(data.sparkSession)
        own = data.where(whole(columns))
        batches = max(1, -(-own.count() // self.batch_size))
        workers, d = min(self.workers, batches), len(columns)
        batch = F.pmod(F.col(key), F.lit(batches)).alias("b")
        share = F.floor(F.col("b") * workers / batches).cast("int").alias("w")
        laid = own.select(batch, F.col(key).alias("k"), vector(columns).alias("x")).select(share, "b", "k", "x")
        if self.batch_size > self.piece_rows:
            return self._by_steps(laid, batches, workers, d, gradient, np.array(start, float))
        rows = staged(laid.repartition(workers, "w").sortWithinPartitions("w", "b", "k", "x").select("w", "b", "x"), "sgd-batches")
        x = np.array(start, float)
        self.scans = 1
        try:
            for _ in range(self.max_iter):
                walked = rows.repartition(workers, "w").sortWithinPartitions("w", "b") if workers > 1 else rows.coalesce(1).sortWithinPartitions("b")
                got = tree_merged(walked.mapInArrow(_walked(gradient, x, self.lr, d), "v binary"), lambda a, b: a + b)
                self.scans += 1
                if got is None:
                    break
                new = got[1:] / got[0]
                moved = np.linalg.norm(new - x)
                x = new
                if moved < self.tol:
                    break
        finally:
            dropped(rows)
        return x

    def _by_steps(self, laid: DataFrame, batches: int, workers: int, d: int, gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
        """The same passes, each step a scan of its batch's rows, which lie together in the staged table."""
        rows = staged(laid.select("b", "k", "x").repartitionByRange("b", "k").sortWithinPartitions("b", "k", "x").select("b", "x"), "sgd-batches")
        self.scans = 1
        try:
            for _ in range(self.max_iter):
                total, seen = np.zeros(len(x)), 0.0
                for w in range(workers):
                    at, n = x, 0.0
                    for b in range(-(-w * batches // workers), -(-(w + 1) * batches // workers)):
                        got = tree_merged(rows.where(F.col("b") == b).select("x").mapInArrow(_pieces(gradient, at, d, self.piece_rows), "v binary"), lambda p, q: p + q)
                        if got is not None:
                            at, n = at - self.lr * got[1:] / got[0], n + got[0]
                    total, seen = total + n * at, seen + n
                self.scans += 1
                if not seen:
                    break
                moved, x = np.linalg.norm(total / seen - x), total / seen
                if moved < self.tol:
                    break
        finally:
            dropped(rows)
        return x


def _pieces(gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, d: int, most: int):
    """(rows, rows * gradient) of a task's rows of a batch, most rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            cells = matrix(b.column(0), d)
            for at in range(0, len(cells), most):
                part = cells[at : at + most]
                state = np.append(len(part), len(part) * np.asarray(gradient(part, x), float))
                total = state if total is None else total + state
        if total is not None:
            yield state_batch(total)

    return run


def _walked(gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, lr: float, d: int):
    """Rows sorted by worker and batch: (rows, rows * model) of each worker after its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, x, seen = None, [], start, 0

        def stepped() -> np.ndarray:
            return x - lr * np.asarray(gradient(np.vstack(parts), x), float) if parts else x

        for b in batches:
            w, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            cells = matrix(b.column(2), d)
            cuts = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (n[1:] != n[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(w)), strict=True):
                if at != (w[lo], n[lo]):
                    x, parts = stepped(), []
                    if at is not None and at[0] != w[lo]:
                        yield state_batch(np.append(seen, seen * x))
                        x, seen = start, 0
                    at = (w[lo], n[lo])
                parts.append(cells[lo:hi])
                seen += hi - lo
        if seen:
            x = stepped()
            yield state_batch(np.append(seen, seen * x))

    return run


@dataclass
class Adam:
    """Moment-scaled steps (Kingma and Ba)."""

    lr: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    max_iter: int = 1000
    tol: float = 1e-6

    def minimize(self, cost: Cost, gradient: Gradient, start: Sequence[float]) -> np.ndarray:
        x = np.array(start, float)
        m, v = np.zeros_like(x), np.zeros_like(x)
        for t in range(1, self.max_iter + 1):
            g = np.asarray(gradient(x), float)
            m = self.beta1 * m + (1 - self.beta1) * g
            v = self.beta2 * v + (1 - self.beta2) * g * g
            step = self.lr * (m / (1 - self.beta1**t)) / (np.sqrt(v / (1 - self.beta2**t)) + self.epsilon)
            x = x - step
            if np.linalg.norm(step) < self.tol:
                break
        return x
