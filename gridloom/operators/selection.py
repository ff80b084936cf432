"""Splits, cross-validation and feature selection, all by keys, so they can be repeated exactly."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from statistics import fmean, stdev

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blocks import folded, moments_merged, moments_of, vector, whole
from gridloom.operators.linalg import solve_checked


def split_point(key: str | Sequence[str], seed: int = 0) -> Column:
    """A number in [0, 1) for each key, spread evenly and the same on every run: the first 32 bits of an MD5."""
    keys = [key] if isinstance(key, str) else list(key)
    spelled = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(spelled), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def train_test_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    at = split_point(key, seed)
    return df.where(at >= test_size), df.where(at < test_size)


def fold(key: str, folds: int) -> Column:
    """Fold number of a whole-number key."""
    return F.pmod(F.col(key), F.lit(folds)).cast("int")


def cross_val_score(fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float], df: DataFrame, key: str, cv: int = 5) -> dict:
    """Train and test scores of each fold with their mean and deviation."""
    if cv < 2:
        raise ValueError("two folds are needed")
    data = df.withColumn("__fold", fold(key, cv)).persist()
    try:
        train, test = [], []
        for k in range(cv):
            rest, held = data.where(F.col("__fold") != k).drop("__fold"), data.where(F.col("__fold") == k).drop("__fold")
            model = fit(rest)
            train.append(float(score(model, rest)))
            test.append(float(score(model, held)))
    finally:
        data.unpersist()
    return {"train_scores": train, "test_scores": test, "mean_test_score": fmean(test), "std_test_score": stdev(test)}


def cross_val_linear(df: DataFrame, columns: Sequence[str], target: str, key: str, cv: int = 5, alpha: float = 0.0) -> dict:
    """Cross-validation of linear least squares (with a ridge penalty ``alpha``) from sums by fold: one scan for all folds.

    A fold's moments are kept apart; a model's are those of all other folds merged, and the scores (R squared) of both sides
    follow from moments as well. Scores are as in ``cross_val_score``; rows with a missing value are left out, a fold without rows raises.
    """
    if cv < 2:
        raise ValueError("two folds are needed")
    d = len(columns) + 1
    size = 1 + d + d * d

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        out = np.zeros((cv, size))
        for k in np.unique(x[:, 0]).astype(int):
            out[k] = moments_of(x[x[:, 0] == k, 1:])
        return out.ravel() if state is None else merge(state, out.ravel())

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = zip(a.reshape(cv, size), b.reshape(cv, size), strict=True)
        return np.concatenate([x if not y[0] else y if not x[0] else moments_merged(x, y) for x, y in pairs])

    rows = df.where(whole([*columns, target]) & F.col(key).isNotNull())
    got = folded(rows, vector([fold(key, cv), *columns, target]), d + 1, step, merge)
    by_fold = np.zeros((cv, size)) if got is None else got.reshape(cv, size)
    if not by_fold[:, 0].all():
        raise ValueError("a fold has no rows")
    train, test = [], []
    for k in range(cv):
        rest = reduce(moments_merged, [by_fold[j] for j in range(cv) if j != k])
        about = rest[d + 1 :].reshape(d, d)
        slope = solve_checked(about[:-1, :-1] + alpha * np.eye(d - 1), about[:-1, -1])
        level = rest[d] - slope @ rest[1:d]
        train.append(_r_squared(rest, slope, level))
        test.append(_r_squared(by_fold[k], slope, level))
    return {"train_scores": train, "test_scores": test, "mean_test_score": fmean(test), "std_test_score": stdev(test)}


def _r_squared(moments: np.ndarray, slope: np.ndarray, level: float) -> float:
    """R squared of a line on rows of which only the moments are known; 1 for a constant target, as the metric has it."""
    d = len(slope) + 1
    about = moments[d + 1 :].reshape(d, d)
    off = moments[d] - level - slope @ moments[1:d]
    left = about[-1, -1] - 2 * slope @ about[:-1, -1] + slope @ about[:-1, :-1] @ slope + moments[0] * off * off
    return float(1 - left / about[-1, -1]) if about[-1, -1] else 1.0


def feature_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, score): absolute correlation with the target, from one aggregate."""
    row = df.agg(*[F.abs(F.corr(c, target)).alias(f"c{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("at"), F.col(f"c{i}").alias("score")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def select_k_best(df: DataFrame, columns: Sequence[str], target: str, k: int) -> DataFrame:
    return feature_scores(df, columns, target).orderBy(F.desc("score"), "at").limit(k)
