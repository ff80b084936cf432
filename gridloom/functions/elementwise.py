"""Elementwise maths as Column expressions; arguments outside a function's domain raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _guarded(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def exp(x: Column) -> Column:
    return F.exp(x)


def log(x: Column) -> Column:
    return _guarded((x > 0) | x.isNull(), F.when(x > 0, F.ln(x)), "log of a non-positive number")


def sqrt(x: Column) -> Column:
    return _guarded((x >= 0) | x.isNull(), F.sqrt(x), "square root of a negative number")


def power(x: Column, e: float) -> Column:
    return F.pow(x, F.lit(float(e)))


def round_half_away(x: Column) -> Column:
    return F.round(x, 0)


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def absolute(x: Column) -> Column:
    return F.abs(x)


def sin(x: Column) -> Column:
    return F.sin(x)


def cos(x: Column) -> Column:
    return F.cos(x)


def tan(x: Column) -> Column:
    return F.tan(x)


def arcsin(x: Column) -> Column:
    return _guarded(F.abs(x).between(0, 1) | x.isNull(), F.asin(x), "arcsin outside [-1, 1]")


def arccos(x: Column) -> Column:
    return _guarded(F.abs(x).between(0, 1) | x.isNull(), F.acos(x), "arccos outside [-1, 1]")


def arctan(x: Column) -> Column:
    return F.atan(x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def is_nan(x: Column) -> Column:
    return F.coalesce(F.isnan(x), F.lit(False))


def is_inf(x: Column) -> Column:
    return F.coalesce(F.abs(x) == float("inf"), F.lit(False))


def is_finite(x: Column) -> Column:
    return ~is_nan(x) & ~is_inf(x) & x.isNotNull()
