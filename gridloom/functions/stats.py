"""Column statistics that skip missing values (NULL and NaN alike); of no values they are 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(c: str | Column, kind: T.DataType | None = None) -> Column:
    """The column with NaN as NULL; only floating types can hold NaN."""
    col = F.col(c) if isinstance(c, str) else c
    if kind is not None and not isinstance(kind, (T.DoubleType, T.FloatType)):
        return col
    return F.when(~F.isnan(col), col)


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def median(c: Column) -> Column:
    return F.coalesce(F.median(c), F.lit(0.0))


def stddev(c: Column) -> Column:
    """Sample deviation; of one value 0."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def variance(c: Column) -> Column:
    return F.coalesce(F.var_samp(c), F.lit(0.0))


def minimum(c: Column) -> Column:
    return F.coalesce(F.min(c).cast("double"), F.lit(0.0))


def maximum(c: Column) -> Column:
    return F.coalesce(F.max(c).cast("double"), F.lit(0.0))


STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": mean, "median": median, "stddev": stddev, "variance": variance, "min": minimum, "max": maximum,
}
