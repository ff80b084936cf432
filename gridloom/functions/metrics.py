"""Regression, classification and clustering metrics as aggregate Columns or small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.blocks import Vectors, folded, vector, whole

#: Most clusters whose centres are sent to every task.
MOST_CLUSTERS = 10_000


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """1 - residual / total sum of squares; 1 for a constant target."""
    total = F.var_pop(y) * F.count(y)
    return F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(1 - F.sum((y - p) * (y - p)) / F.when(total != 0, total))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def _share(hit: Column, of: Column) -> Column:
    n = F.count_if(of)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(hit) / F.when(n != 0, n))


def precision(y: Column, p: Column, positive=1) -> Column:
    """Right share of predicted positives; 0 if there are none."""
    return _share((y == positive) & (p == positive), p == positive)


def recall(y: Column, p: Column, positive=1) -> Column:
    """Found share of true positives; 0 if there are none."""
    return _share((y == positive) & (p == positive), y == positive)


def f1(y: Column, p: Column, positive=1) -> Column:
    hit = F.count_if((y == positive) & (p == positive))
    all_ = F.count_if(p == positive) + F.count_if(y == positive)
    return F.when(all_ == 0, F.lit(0.0)).otherwise(2 * hit / F.when(all_ != 0, all_))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n) for every pair of classes that occurs."""
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the adjusted Rand index of two labellings as ``v``; 1 if both are trivial alike."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cell = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = cell.agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("n"))
    rows = cell.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("i"))
    cols = cell.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("j"))
    all_ = both.crossJoin(rows).crossJoin(cols)  # three one-row tables
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("i") + F.col("j")) / 2
    return all_.select(F.when(top == expected, F.lit(1.0)).otherwise((F.col("ij") - expected) / F.when(top != expected, top - expected)).alias("v"))


def silhouette(df: DataFrame, columns: Sequence[str] | Vectors, label: str) -> DataFrame:
    """One row with the mean silhouette by squared Euclidean distance as ``v``.

    Mean squared distances to a cluster follow from its size, centre and mean squared distance to it, so two scans add up
    small blocks of numbers and no pairs of rows are made. A cluster of one scores 0. Rows with a missing
    value or label are left out; no rows give null.
    """
    own = df.where(whole(columns) & F.col(label).isNotNull()).select(F.col(label).alias("__c"), vector(columns).alias("__x"))
    names = own.select("__c").distinct().limit(MOST_CLUSTERS + 1).collect()
    if len(names) > MOST_CLUSTERS:
        raise ValueError("too many clusters to hold beside every row")
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([(None,)], "v double")
    numbers = spark.createDataFrame([(r["__c"], float(i)) for i, r in enumerate(names)], T.StructType([own.schema["__c"], T.StructField("__i", T.DoubleType())]))
    rows = own.join(F.broadcast(numbers), "__c").select(F.concat(F.array("__i"), "__x").alias("x"))  # at most MOST_CLUSTERS numbers
    k, d = len(names), len(columns)

    def sums(s: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        """Sizes, sums and squared norms by cluster."""
        at = x[:, 0].astype(int)
        out = np.zeros((k, d + 2))
        np.add.at(out[:, 1:-1], at, x[:, 1:])
        out[:, 0] = np.bincount(at, minlength=k)
        out[:, -1] = np.bincount(at, (x[:, 1:] ** 2).sum(axis=1), k)
        return out.ravel() if s is None else s + out.ravel()

    add = lambda a, b: a + b
    got = folded(rows, F.col("x"), d + 1, sums, add).reshape(k, d + 2)
    n, centre = got[:, 0], got[:, 1:-1] / got[:, :1]
    spread = np.maximum(got[:, -1] / n - (centre**2).sum(axis=1), 0)  # mean squared distance to the centre

    def widths(s: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        at, here = x[:, 0].astype(int), np.arange(len(x))
        far = np.empty((len(x), k))
        for c in range(k):
            far[:, c] = ((x[:, 1:] - centre[c]) ** 2).sum(axis=1) + spread[c]
        a = far[here, at] * n[at] / np.maximum(n[at] - 1, 1)
        far[here, at] = np.inf
        b = far.min(axis=1)
        width = np.maximum(a, b)
        scored = (n[at] > 1) & (width > 0)
        each = np.where(scored & np.isfinite(b), (b - a) / np.where(scored, width, 1), 0.0)
        out = np.array([each.sum(), float(len(x))])
        return out if s is None else s + out

    total = folded(rows, F.col("x"), d + 1, widths, add)
    return spark.createDataFrame([(float(total[0] / total[1]),)], "v double")
