"""Scalers, row normalisation, one-hot encoding and polynomial features.

Fitting is one aggregate; transforming is a projection with the fitted numbers as
literals, so it fuses with whatever surrounds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFitted(RuntimeError):
    """transform before fit."""


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.withColumns(new)


@dataclass
class StandardScaler:
    """(x - mean) / population deviation; a constant column is divided by 1."""

    columns: Sequence[str]
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> StandardScaler:
        row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(self.columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.means = {c: row[f"m{i}"] for i, c in enumerate(self.columns)}
        self.deviations = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(self.columns)}
        return self

    def _ready(self) -> None:
        if not self.means:
            raise NotFitted("fit the scaler first")

    def transform(self, df: DataFrame) -> DataFrame:
        self._ready()
        return _replace(df, {c: (F.col(c) - self.means[c]) / self.deviations[c] for c in self.columns})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._ready()
        return _replace(df, {c: F.col(c) * self.deviations[c] + self.means[c] for c in self.columns})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class MinMaxScaler:
    """Columns to [low, high]; a constant column becomes low."""

    columns: Sequence[str]
    low: float = 0.0
    high: float = 1.0
    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.low >= self.high:
            raise ValueError("low must be less than high")

    def fit(self, df: DataFrame) -> MinMaxScaler:
        row = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(self.columns) for n, f in (("a", F.min), ("b", F.max))]).first()
        self.least = {c: row[f"a{i}"] for i, c in enumerate(self.columns)}
        self.most = {c: row[f"b{i}"] for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.least:
            raise NotFitted("fit the scaler first")
        out = {}
        for c in self.columns:
            width = self.most[c] - self.least[c]
            out[c] = F.lit(self.low) if width == 0 else self.low + (self.high - self.low) * (F.col(c) - self.least[c]) / width
        return _replace(df, out)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if not self.least:
            raise NotFitted("fit the scaler first")
        return _replace(df, {c: self.least[c] + (F.col(c) - self.low) * (self.most[c] - self.least[c]) / (self.high - self.low) for c in self.columns})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def normalize_rows(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Each row by its L1, L2 or largest magnitude; a zero row stays."""
    sizes = [F.abs(F.col(c)) for c in columns]
    if norm == "l1":
        n = sum(sizes[1:], sizes[0])
    elif norm == "l2":
        n = F.sqrt(sum((s * s for s in sizes[1:]), sizes[0] * sizes[0]))
    elif norm == "max":
        n = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    else:
        raise ValueError(f"unknown norm: {norm}")
    by = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return df.withColumns({c: F.col(c) / by for c in columns})


@dataclass
class OneHotEncoder:
    """Indicator columns of the sorted distinct values; unseen values have none set."""

    columns: Sequence[str]
    most: int = 10_000
    categories: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> OneHotEncoder:
        for c in self.columns:
            values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(self.most + 1).collect()]
            if len(values) > self.most:
                raise ValueError(f"column {c} has too many distinct values")
            self.categories[c] = sorted(values)
        return self

    def names(self, c: str) -> list[str]:
        return [f"{c}_{v}" for v in self.categories[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.categories:
            raise NotFitted("fit the encoder first")
        new = {n: F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c in self.columns for n, v in zip(self.names(c), self.categories[c], strict=True)}
        return df.withColumns(new).drop(*self.columns)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """The first category that is set, or the first of all."""
        if not self.categories:
            raise NotFitted("fit the encoder first")
        new = {}
        for c in self.columns:
            hits = [F.when(F.col(f"`{n}`") == 1, F.lit(v)) for n, v in zip(self.names(c), self.categories[c], strict=True)]
            new[c] = F.coalesce(*hits, F.lit(self.categories[c][0]))
        return df.withColumns(new).drop(*[n for c in self.columns for n in self.names(c)])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2, bias: bool = True) -> DataFrame:
    """df with all monomials of the columns up to a degree, named like ``a*a*b``."""
    new = {"1": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for names in combinations_with_replacement(columns, d):
            term = F.col(names[0]).cast("double")
            for n in names[1:]:
                term = term * F.col(n)
            new["*".join(names)] = term
    return df.select("*", *[c.alias(n) for n, c in new.items() if n not in df.columns])
