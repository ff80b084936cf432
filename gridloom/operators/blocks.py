"""Rows as blocks of numbers: what a task adds up over its Arrow batches, and how tasks' sums come together.

A state is a vector of doubles in one binary cell, as large as the columns ask for and no larger than that, however
many rows there are. Tasks' states are merged in two levels by tasks, so one state reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.package import ship

#: Cells of a batch that are taken at once.
CELLS = 1 << 22
State = np.ndarray
Merge = Callable[[State, State], State]


@dataclass(frozen=True)
class Vectors:
    """A column that holds a row's numbers as an array of d."""

    column: str
    d: int

    def __len__(self) -> int:
        return self.d


def vector(columns: Sequence[str | Column] | Vectors) -> Column:
    """One array of doubles from columns, or the column that is one."""
    if isinstance(columns, Vectors):
        return F.col(columns.column).cast("array<double>")
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def whole(columns: Sequence[str] | Vectors) -> Column:
    """Whether a row has all of the columns, or a vector of the right length; null and NaN are missing."""
    if isinstance(columns, Vectors):
        v = F.col(columns.column)
        return F.coalesce((F.size(v) == columns.d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """(rows, d) doubles of a column of vectors."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), d)


def pieces(x: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, x.shape[1]))
    for at in range(0, len(x), step):
        yield x[at : at + step]


def state_batch(state: State) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(state, np.float64).tobytes()], pa.binary())], names=["v"])


def _merged(merge: Merge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                x = np.frombuffer(v.as_buffer(), np.float64)
                total = x if total is None else merge(total, x)
        if total is not None:
            yield state_batch(total)

    return run


def tree_merged(states: DataFrame, merge: Merge) -> State | None:
    """One state of many rows (v binary); None if there are none."""
    ship(states.sparkSession)
    parts = states.rdd.getNumPartitions()
    if parts > 4:
        states = states.repartition(max(1, round(parts**0.5))).mapInArrow(_merged(merge), "v binary")
    got = states.coalesce(1).mapInArrow(_merged(merge), "v binary").collect() if parts > 1 else states.collect()
    out = None
    for r in got:
        x = np.frombuffer(r["v"], np.float64)
        out = x if out is None else merge(out, x)
    return out


def folded(df: DataFrame, vectors: Column, d: int, step: Callable[[State | None, np.ndarray], State], merge: Merge) -> State | None:
    """The state of all rows' vectors: ``step`` takes a block of a task's rows into the task's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for x in pieces(matrix(b.column(0), d)):
                state = step(state, x)
        if state is not None:
            yield state_batch(state)

    ship(df.sparkSession)
    return tree_merged(df.select(vectors.alias("x")).mapInArrow(run, "v binary"), merge)


# moments: (number, means, sums of products about the means), merged pairwise without cancellation


def moments_of(x: np.ndarray) -> State:
    mean = x.mean(axis=0)
    c = x - mean
    return np.concatenate(([float(len(x))], mean, (c.T @ c).ravel()))


def moments_merged(a: State, b: State) -> State:
    d = round(((len(a) - 1) + 0.25) ** 0.5 - 0.5)  # 1 + d + d * d numbers
    n, m = a[0], b[0]
    gap = b[1 : d + 1] - a[1 : d + 1]
    out = np.empty_like(a)
    out[0] = n + m
    out[1 : d + 1] = a[1 : d + 1] + gap * (m / (n + m))
    out[d + 1 :] = a[d + 1 :] + b[d + 1 :] + (np.outer(gap, gap) * (n * m / (n + m))).ravel()
    return out


def moments(df: DataFrame, columns: Sequence[str] | Vectors) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means, and sums of products about the means: one scan, one d x d state a task.

    Rows with a missing value in any column are left out.
    """
    d = len(columns)
    step = lambda state, x: moments_of(x) if state is None else moments_merged(state, moments_of(x))
    got = folded(df.where(whole(columns)), vector(columns), d, step, moments_merged)
    if got is None:
        return 0, np.zeros(d), np.zeros((d, d))
    return int(got[0]), got[1 : d + 1].copy(), got[d + 1 :].reshape(d, d).copy()
