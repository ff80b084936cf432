"""Linear and logistic models. Squares need one aggregate over the data, whatever the solver does after."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import metrics
from gridloom.functions.elementwise import sigmoid
from gridloom.operators.linalg import centred_gram, gram, solve_checked


@dataclass
class _Linear:
    columns: Sequence[str]
    target: str
    intercept: float | None = None
    coef: np.ndarray = field(default_factory=lambda: np.array([]))

    def linear(self) -> Column:
        if self.intercept is None:
            raise RuntimeError("fit the model first")
        out = F.lit(float(self.intercept))
        for w, c in zip(self.coef, self.columns, strict=True):
            out = out + F.lit(float(w)) * F.col(c)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.linear())

    def score(self, df: DataFrame) -> DataFrame:
        """One row with R squared as ``v``."""
        return df.agg(metrics.r2(F.col(self.target), self.linear()).alias("v"))


@dataclass
class LinearRegression(_Linear):
    """Least squares with an intercept by the normal equations; a singular system raises."""

    def fit(self, df: DataFrame) -> LinearRegression:
        return self._solve(df, 0.0)

    def _solve(self, df: DataFrame, alpha: float):
        """Centred sums keep digits that a large offset would cancel; the intercept follows from the means."""
        means, g = centred_gram(df, self.columns, self.target)
        d = len(self.columns)
        self.coef = solve_checked(g[:d, :d] + alpha * np.eye(d), g[:d, d])
        self.intercept = float(means[d] - means[:d] @ self.coef)
        return self


@dataclass
class Ridge(LinearRegression):
    """Least squares with alpha times the squared weights; the intercept is free."""

    alpha: float = 1.0

    def fit(self, df: DataFrame) -> Ridge:
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")
        return self._solve(df, self.alpha)


@dataclass
class Lasso(_Linear):
    """Coordinate descent on half the mean squared residual plus alpha times the absolute weights.

    The intercept is the target's mean and the columns are not centred. All rounds
    run on the sums of products, so the data are read once.
    """

    alpha: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-4

    def fit(self, df: DataFrame) -> Lasso:
        g = gram(df, self.columns, self.target)
        n, d = g[0, 0], len(self.columns)
        b = g[0, d + 1] / n
        xx, xy = g[1 : d + 1, 1 : d + 1], g[1 : d + 1, d + 1] - b * g[0, 1 : d + 1]
        w = np.zeros(d)
        for _ in range(self.max_iter):
            moved = 0.0
            for j in range(d):
                if xx[j, j] == 0:
                    new = 0.0
                else:
                    rho = (xy[j] - xx[j] @ w + xx[j, j] * w[j]) / n
                    new = np.sign(rho) * max(abs(rho) - self.alpha, 0.0) / (xx[j, j] / n)
                moved += abs(new - w[j])
                w[j] = new
            if moved < self.tol:
                break
        self.intercept, self.coef = float(b), w
        return self


@dataclass
class LogisticRegression(_Linear):
    """Full-batch gradient descent from zeros on the mean log-loss; one aggregate a round."""

    lr: float = 0.01
    max_iter: int = 1000
    tol: float = 1e-6

    def fit(self, df: DataFrame) -> LogisticRegression:
        data = df.select(*[F.col(c).cast("double").alias(c) for c in self.columns], F.col(self.target).cast("double").alias(self.target)).persist()
        try:
            self.intercept, self.coef = 0.0, np.zeros(len(self.columns))
            for _ in range(self.max_iter):
                err = sigmoid(self.linear()) - F.col(self.target)
                row = data.agg(F.avg(err).alias("b"), *[F.avg(err * F.col(c)).alias(f"w{i}") for i, c in enumerate(self.columns)]).first()
                step = self.lr * np.array([row["b"], *[row[f"w{i}"] for i in range(len(self.columns))]])
                self.intercept -= step[0]
                self.coef = self.coef - step[1:]
                if np.abs(step).sum() < self.tol:
                    break
        finally:
            data.unpersist()
        return self

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, sigmoid(self.linear()))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, F.when(sigmoid(self.linear()) >= 0.5, 1.0).otherwise(0.0))

    def score(self, df: DataFrame) -> DataFrame:
        """One row with the share of right classes as ``v``."""
        return self.predict(df, "__p").agg(metrics.accuracy(F.col(self.target), F.col("__p")).alias("v"))
