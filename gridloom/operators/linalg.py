"""Linear algebra: products by tiles, singular values by triangles of partitions, small dense algebra on the driver.

Anything proportional to the number of rows stays in Spark; d x d results
(Gram, covariance, inverse) are collected, with their size checked first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import factor, tsqr
from gridloom.operators.array import DRIVER_CELLS, NDArray
from gridloom.operators.blocks import Vectors, moments
from gridloom.operators.tiles import Tiles

#: Cells up to which a square array is solved as one numpy array.
SOLVED_WHOLE = 250_000
#: Columns up to which sums of products are plain SQL sums.
SUMS_IN_SQL = 12
#: Pivots below this are taken as zero.
TINY = 1e-10


def to_numpy(a: NDArray) -> np.ndarray:
    if a.size > DRIVER_CELLS:
        raise ValueError(f"an array of {a.size} cells is too large for the driver")
    out = np.zeros(a.shape)
    got = a.df.toPandas()
    out[tuple(got[f"i{k}"].to_numpy() for k in range(a.ndim))] = got["v"].to_numpy()
    return out


def from_numpy(spark: SparkSession, x: np.ndarray) -> NDArray:
    return NDArray.literal(spark, x.tolist())


def _square(a: NDArray) -> np.ndarray:
    if not a.is_square():
        raise ValueError("a square array is needed")
    return to_numpy(a)


def matmul(a: NDArray, b: NDArray) -> NDArray:
    """Contraction over the inner index, by dense tiles: cells move once into tiles, and tiles are what meets."""
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[0]:
        raise ValueError("inner dimensions differ")
    return Tiles.of_array(a).matmul(Tiles.of_array(b)).to_array()


def dot(a: NDArray, b: NDArray):
    """Matrix product; of two vectors the inner product."""
    if a.ndim == 1 and b.ndim == 1:
        if a.shape != b.shape:
            raise ValueError("shapes differ")
        return a.df.join(b.df.withColumnRenamed("v", "w"), "i0").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return matmul(a, b)


def gram(df: DataFrame, columns: Sequence[str], target: str | None = None) -> np.ndarray:
    """Sums of products of (1, columns, target): one scan of any number of rows, d x d numbers to the driver.

    Few columns are one SQL aggregate; many are summed by Arrow batches, one d x d block a task, added in two levels.
    There rows with a missing value are left out, and products are taken about the means first.
    """
    names = [*columns, *([target] if target else [])]
    if len(names) > SUMS_IN_SQL:
        n, mean, about = moments(df, names)
        one = np.concatenate(([1.0], mean))
        out = n * np.outer(one, one)
        out[1:, 1:] += about
        return out
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    d = len(cols)
    sums = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return out


def centred_gram(df: DataFrame, columns: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """Means of (columns, target) and sums of products less them, from one stable aggregate.

    Rows with a missing value anywhere are left out of all sums.
    """
    names = [*columns, target]
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    cols = [F.when(whole, F.col(c).cast("double")) for c in names]
    d = len(names)
    row = df.agg(F.count(cols[0]).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (row[f"s{i}_{j}"] or 0.0) * row["n"]
    return np.array([row[f"m{i}"] or 0.0 for i in range(d)]), out


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i0, i1, v): sample covariances of the columns, from one aggregate."""
    d = len(columns)
    row = df.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)])
    cells = [F.struct(F.lit(i).cast("long").alias("i0"), F.lit(j).cast("long").alias("i1"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("v")) for i in range(d) for j in range(d)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def lu_arrays(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, L, U) with P a = L U by partial pivoting; a vanishing pivot raises."""
    n = len(a)
    u, low, p = a.astype(float).copy(), np.eye(n), np.eye(n)
    for k in range(n):
        top = k + int(np.argmax(np.abs(u[k:, k])))
        if abs(u[top, k]) < TINY:
            raise ValueError("the matrix is singular")
        if top != k:
            u[[k, top]], p[[k, top]] = u[[top, k]], p[[top, k]]
            low[[k, top], :k] = low[[top, k], :k]
        factors = u[k + 1 :, k] / u[k, k]
        low[k + 1 :, k] = factors
        u[k + 1 :] -= np.outer(factors, u[k])
    return p, low, np.triu(u)


def lu(a: NDArray) -> tuple[NDArray, NDArray, NDArray]:
    """L, U and the row permutation P of a square array; a large one is factored where it lies, panel by panel."""
    if a.size > SOLVED_WHOLE:
        f = factor.lu(factor.rows_of(a))
        places = f.permutation().select(F.col("place").alias("i0"), "row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(f.n - 1).cast("long"))).alias("i1"))
        return f.lower(), f.upper(), NDArray(places.select("i0", "i1", (F.col("i1") == F.col("row")).cast("double").alias("v")), a.shape)
    p, low, up = lu_arrays(_square(a))
    spark = a.df.sparkSession
    return from_numpy(spark, low), from_numpy(spark, up), from_numpy(spark, p)


def solve_checked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution by pivoted elimination; raises on a vanishing pivot."""
    p, low, up = lu_arrays(a)
    y = p @ b
    for k in range(len(a)):
        y[k] = y[k] - low[k, :k] @ y[:k]
    for k in reversed(range(len(a))):
        y[k] = (y[k] - up[k, k + 1 :] @ y[k + 1 :]) / up[k, k]
    return y


def inverse(a: NDArray) -> NDArray:
    """The inverse; of a large array by sweeping panels out of its rows where they lie."""
    if a.size > SOLVED_WHOLE:
        return factor.inverse(factor.rows_of(a))
    x = _square(a)
    return from_numpy(a.df.sparkSession, solve_checked(x, np.eye(len(x))))


def determinant(a: NDArray) -> float:
    """The determinant; infinite if it is beyond a double (``factor.determinant`` gives its logarithm)."""
    if a.size > SOLVED_WHOLE:
        sign, log = factor.determinant(factor.rows_of(a))
        with np.errstate(over="ignore"):
            return float(sign * np.exp(log)) if sign else 0.0
    x = _square(a)
    try:
        p, _, up = lu_arrays(x)
    except ValueError:
        return 0.0
    return float(np.linalg.det(p).round() * np.prod(np.diag(up)))


def eigen(a: NDArray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns; complex ones raise."""
    x = _square(a)
    if np.allclose(x, x.T, atol=1e-12):
        values, vectors = np.linalg.eigh(x)
    else:
        values, vectors = np.linalg.eig(x)
        if np.abs(values.imag).max() > TINY:
            raise ValueError("the eigenvalues are complex")
        values, vectors = values.real, vectors.real
    order = np.argsort(-values, kind="stable")
    return values[order], signed(vectors[:, order])


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest component is positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _as_rows(a: NDArray) -> tuple[DataFrame, Vectors]:
    """(i0, x) of an array: a row's cells, which are at most ``MOST_COLUMNS``, as one array."""
    if a.shape[1] > tsqr.MOST_COLUMNS:
        raise ValueError(f"an array with both sides over {tsqr.MOST_COLUMNS} has no triangle that one task can hold")
    cells = F.sort_array(F.collect_list(F.struct("i1", F.col("v").cast("double").alias("v"))))
    return a.df.groupBy("i0").agg(F.transform(cells, lambda c: c["v"]).alias("x")), Vectors("x", a.shape[1])


def svd(a: NDArray) -> tuple[NDArray, np.ndarray, NDArray]:
    """Thin U, singular values and transposed V, by the triangles of partitions.

    The longer side's vectors stay a distributed array. The shorter side's vectors have their largest component positive;
    the others' are zero where the singular value is no more than rounding.
    """
    if a.ndim != 2:
        raise ValueError("a 2-D array is needed")
    if a.shape[0] < a.shape[1]:
        v, s, ut = svd(a.transpose())
        return ut.transpose(), s, v.transpose()
    rows, vectors = _as_rows(a)
    left, s, vt = tsqr.svd(rows, vectors)
    return NDArray(tsqr.exploded(left, "i0", "u"), a.shape), s, from_numpy(a.df.sparkSession, vt)


def rank(a: NDArray) -> int:
    """Number of singular values above rounding."""
    if a.ndim != 2:
        raise ValueError("a 2-D array is needed")
    if a.shape[0] < a.shape[1]:
        return rank(a.transpose())
    return tsqr.rank(*_as_rows(a), a.shape[0])


def convolve(a: NDArray, kernel: Sequence[Sequence[float]], mode: str = "full") -> NDArray:
    """2-D convolution with a small kernel: every cell adds its share to the cells it reaches."""
    if a.ndim != 2 or mode not in ("full", "same", "valid"):
        raise ValueError("a 2-D array and mode full, same or valid are needed")
    kh, kw = len(kernel), len(kernel[0])
    (n, m) = a.shape
    if mode == "valid" and (kh > n or kw > m):
        raise ValueError("the kernel is larger than the array")
    taps = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.lit(float(kernel[p][q])).alias("w")) for p in range(kh) for q in range(kw)])
    top, left, shape = {"full": (0, 0, (n + kh - 1, m + kw - 1)), "same": ((kh - 1) // 2, (kw - 1) // 2, (n, m)), "valid": (kh - 1, kw - 1, (n - kh + 1, m - kw + 1))}[mode]
    spread = a.df.select("i0", "i1", "v", F.explode(taps).alias("t")).select(
        (F.col("i0") + F.col("t.p") - top).alias("i0"), (F.col("i1") + F.col("t.q") - left).alias("i1"), (F.col("v") * F.col("t.w")).alias("v")
    )
    inside = spread.where((F.col("i0") >= 0) & (F.col("i0") < shape[0]) & (F.col("i1") >= 0) & (F.col("i1") < shape[1]))
    return NDArray(inside.groupBy("i0", "i1").agg(F.sum("v").alias("v")), shape)
