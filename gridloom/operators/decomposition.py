"""Principal components from the covariance of the columns: one scan that sums d x d moments by task, then a small eigenproblem."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import tsqr
from gridloom.operators.blocks import Vectors, moments
from gridloom.operators.linalg import signed


@dataclass
class PCA:
    """Components are unit rows, the largest entry of each positive. Rows with a missing value are left out of the fit."""

    columns: Sequence[str] | Vectors
    n: int = 2
    components: np.ndarray | None = None
    mean: np.ndarray | None = None
    explained_variance: np.ndarray | None = None
    explained_variance_ratio: np.ndarray | None = None

    def fit(self, df: DataFrame) -> PCA:
        d = len(self.columns)
        if not 1 <= self.n <= d:
            raise ValueError("the number of components must lie between 1 and the number of columns")
        rows, centre, about = moments(df, self.columns)
        if rows < 2:
            raise ValueError("two rows are needed")
        cov = about / (rows - 1)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[: self.n]
        self.mean, self.components = centre, signed(vectors[:, order]).T
        self.explained_variance = values[order]
        self.explained_variance_ratio = values[order] / values.sum()
        return self

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        if self.components is None:
            raise RuntimeError("fit the model first")
        if isinstance(self.columns, Vectors):
            shifted = tsqr.times(df, self.columns, self.components.T, "__pc")
            at = self.components @ self.mean
            return shifted.withColumns({f"{prefix}{k}": F.col("__pc")[k] - float(at[k]) for k in range(self.n)}).drop("__pc")
        new = {}
        for k, axis in enumerate(self.components):
            new[f"{prefix}{k}"] = sum(((F.col(c) - float(m)) * float(a) for c, m, a in zip(self.columns, self.mean, axis, strict=True)), F.lit(0.0))
        return df.withColumns(new)

    def inverse_transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        if self.components is None:
            raise RuntimeError("fit the model first")
        if isinstance(self.columns, Vectors):
            back = tsqr.times(df, [f"{prefix}{k}" for k in range(self.n)], self.components, "__x")
            mean = F.array(*[F.lit(float(m)) for m in self.mean])
            return back.withColumn(self.columns.column, F.zip_with("__x", mean, lambda a, m: a + m)).drop("__x")
        new = {}
        for j, c in enumerate(self.columns):
            new[c] = sum((F.col(f"{prefix}{k}") * float(self.components[k, j]) for k in range(self.n)), F.lit(float(self.mean[j])))
        return df.withColumns(new)

    def fit_transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return self.fit(df).transform(df, prefix)
