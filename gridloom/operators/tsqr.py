"""Tall matrices by their triangular factor: QR of partitions, merged in a tree.

Each task keeps one d x d triangle: the R of all rows it has read. Triangles are stacked and factored again in two levels, so
one reaches the driver. Singular values and right vectors of the whole matrix are those of that triangle, without squaring the
matrix as a Gram matrix does, so small singular values keep their digits; left vectors come by one more pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.blocks import Vectors, folded, matrix, vector, whole
from gridloom.sources.package import ship

#: Most columns: a triangle of them is half a gigabyte.
MOST_COLUMNS = 8192


def _triangle(rows: np.ndarray, d: int) -> np.ndarray:
    """R of rows, d x d, filled up with zero rows."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack((r, np.zeros((d - len(r), d))))


def triangle(df: DataFrame, columns: Sequence[str] | Vectors) -> np.ndarray:
    """R with R'R = X'X for the rows X of df: d x d, its diagonal not negative."""
    d = len(columns)
    if not 1 <= d <= MOST_COLUMNS:
        raise ValueError(f"from 1 to {MOST_COLUMNS} columns are needed")

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        if not np.isfinite(x).all():
            raise ValueError("missing or infinite values have no factorisation")
        return _triangle(x if state is None else np.vstack((state.reshape(d, d), x)), d).ravel()

    merge = lambda a, b: _triangle(np.vstack((a.reshape(d, d), b.reshape(d, d))), d).ravel()
    got = folded(df, vector(columns), d, step, merge)
    r = np.zeros((d, d)) if got is None else got.reshape(d, d)
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def times(df: DataFrame, columns: Sequence[str] | Vectors, y: np.ndarray, name: str = "u") -> DataFrame:
    """df with ``name``, the row's product with a small matrix y, as an array: one pass. Null where the row has a missing value."""
    d, own = len(columns), [c for c in df.columns if c != name]
    schema = T.StructType([*[df.schema[c] for c in own], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(len(own))
            known = np.asarray(vectors.is_valid())
            out = matrix(vectors.filter(pa.array(known)), d) @ y
            offsets = np.concatenate(([0], np.cumsum(known))) * y.shape[1]
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], made], names=[*own, name])

    ship(df.sparkSession)
    return df.select(*own, F.when(whole(columns), vector(columns)).alias("__x")).mapInArrow(run, schema)


def singular_values(df: DataFrame, columns: Sequence[str] | Vectors) -> np.ndarray:
    """Singular values of df's rows, largest first: as many as there are columns, zeros included."""
    return np.linalg.svd(triangle(df, columns), compute_uv=False)


def rank(df: DataFrame, columns: Sequence[str] | Vectors, rows: int | None = None) -> int:
    """Number of singular values above rounding (largest dimension x machine precision x the largest)."""
    s = singular_values(df, columns)
    n = max(len(columns), rows if rows is not None else df.count())
    return int((s > s[0] * n * np.finfo(float).eps).sum())


def svd(df: DataFrame, columns: Sequence[str] | Vectors, name: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with left vectors' rows as arrays, singular values, right vectors as rows).

    Right vectors have their largest component positive. Left vectors of singular values that are no more than rounding are zero.
    """
    _, s, vt = np.linalg.svd(triangle(df, columns))
    at = np.abs(vt).argmax(axis=1)
    vt = vt * np.where(vt[np.arange(len(vt)), at] < 0, -1.0, 1.0)[:, None]
    real = s > s[0] * len(columns) * np.finfo(float).eps * 16
    scale = np.where(real, 1 / np.where(real, s, 1.0), 0.0)
    return times(df, columns, vt.T * scale, name), s, vt


def qr(df: DataFrame, columns: Sequence[str] | Vectors, name: str = "q") -> tuple[DataFrame, np.ndarray]:
    """(df with the rows of Q as arrays, R); raises if the columns depend on each other."""
    r = triangle(df, columns)
    s = np.linalg.svd(r, compute_uv=False)
    if s[-1] <= s[0] * len(columns) * np.finfo(float).eps * 16:
        raise ValueError("the columns depend on each other")
    return times(df, columns, np.linalg.solve(r, np.eye(len(r))), name), r


def exploded(df: DataFrame, position: str, name: str) -> DataFrame:
    """(i0, i1, v) of an array column, one row for each cell."""
    return df.select(F.col(position).cast("long").alias("i0"), F.posexplode(name).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), "v")
