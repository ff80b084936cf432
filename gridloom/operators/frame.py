"""Tables: lazy, Column-first operations with checked names.

A ``Frame`` is a Spark DataFrame with the key columns that order its rows. Every
operator returns a new Frame; nothing runs until a result is asked for. Preconditions
that metadata can tell raise ``ValueError`` (``KeyError`` for unknown columns) at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import stats
from gridloom.functions.quantiles import order_statistics
from gridloom.operators.order import first_rows, row_range, with_position

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "outer", "full": "outer", "left_semi": "left_semi", "left_anti": "left_anti", "cross": "cross"}
NUMERIC = (T.NumericType,)


class Frame:
    """A table with named columns and an order."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = ()):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise KeyError(f"no such key columns: {missing}")
        self.df, self.keys = df, tuple(keys)

    # construction and metadata

    @classmethod
    def empty(cls, spark: SparkSession, columns: Sequence[str] = (), kind: str = "double") -> Frame:
        """No rows; with the given columns, which must be distinct and not blank."""
        _check_names(columns)
        return cls(spark.createDataFrame([], T.StructType([T.StructField(c, T._parse_datatype_string(kind)) for c in columns])))

    @classmethod
    def from_columns(cls, spark: SparkSession, data: Mapping[str, Sequence[float]]) -> Frame:
        """Small literal table: equally long finite columns; rows are numbered in ``_rid``."""
        _check_names(list(data))
        sizes = {len(v) for v in data.values()}
        if not data or len(sizes) != 1:
            raise ValueError("columns must be given and equally long")
        for name, values in data.items():
            if any(v is None or v != v or v in (float("inf"), float("-inf")) for v in values):
                raise ValueError(f"column {name} holds a value that is not finite")
        schema = ", ".join(["_rid long", *(f"`{c}` double" for c in data)])
        rows = [(i, *map(float, r)) for i, r in enumerate(zip(*data.values(), strict=True))]
        return cls(spark.createDataFrame(rows, schema), ["_rid"])

    def _with(self, df: DataFrame, keys: Sequence[str] | None = None) -> Frame:
        kept = [k for k in (self.keys if keys is None else keys) if k in df.columns]
        return Frame(df, kept)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != "_rid"]

    def cols(self) -> int:
        return len(self.columns)

    def rows(self) -> int:
        return self.df.count()

    def shape(self) -> tuple[int, int]:
        return self.rows(), self.cols()

    def info(self) -> str:
        return f"rows: {self.rows()}\ncolumns: {self.cols()}\n" + "\n".join(f"  {f.name}: {f.dataType.simpleString()}" for f in self.df.schema.fields)

    def describe(self, columns: Sequence[str] | None = None) -> DataFrame:
        """(column, count, mean, stddev, min, q25, q50, q75, max) of each numeric column; quartiles are exact."""
        names = list(columns or self._numeric())
        self._known(*names)
        present = {c: stats.present(c, self.df.schema[c].dataType).cast("double") for c in names}
        quarters = order_statistics(self.df, present, (0.25, 0.5, 0.75))
        measures = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
        row = self.df.agg(*[f(present[c]).alias(f"{m}{i}") for i, c in enumerate(names) for m, f in measures.items()])
        parts = [
            F.struct(F.lit(c).alias("column"), *[F.col(f"{m}{i}").alias(m) for m in ("count", "mean", "stddev", "min")], *[F.lit(q).cast("double").alias(n) for n, q in zip(("q25", "q50", "q75"), quarters[c], strict=True)], F.col(f"max{i}").alias("max"))
            for i, c in enumerate(names)
        ]
        return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")

    def _known(self, *names: str) -> None:
        unknown = [n for n in names if n not in self.df.columns]
        if unknown:
            raise KeyError(f"no such columns: {unknown}")

    def _order(self) -> tuple[str, ...]:
        if not self.keys:
            raise ValueError("this operator depends on row order: give the frame key columns")
        return self.keys

    def _numeric(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name != "_rid"]

    # projection and schema

    def __getitem__(self, name: str) -> Column:
        self._known(name)
        return self.df[name]

    def select(self, names: Sequence[str]) -> Frame:
        """Columns by name, repeated names once; order keys stay usable only if selected."""
        if not names:
            raise ValueError("no columns to select")
        self._known(*names)
        return self._with(self.df.select(*dict.fromkeys(names)))

    def add_column(self, name: str, value: Column) -> Frame:
        if not name or name in self.df.columns:
            raise ValueError(f"column name is blank or taken: {name!r}")
        return self._with(self.df.withColumn(name, value))

    def add_column_values(self, name: str, values: DataFrame, on: Sequence[str]) -> Frame:
        """A column that comes from another table with the same key."""
        if not name or name in self.df.columns:
            raise ValueError(f"column name is blank or taken: {name!r}")
        return self._with(self.df.join(values.select(*on, name), list(on), "left"))

    def add_row(self, values: Mapping[str, object]) -> Frame:
        if set(values) != set(self.df.columns):
            raise ValueError("a row needs a value for every column")
        row = self.df.sparkSession.createDataFrame([tuple(values[c] for c in self.df.columns)], self.df.schema)
        return self._with(self.df.unionByName(row))

    def remove_column(self, name: str) -> Frame:
        self._known(name)
        return self._with(self.df.drop(name))

    def remove_row(self, position: int) -> Frame:
        """Without the row at a position by keys; the position must exist."""
        if position < 0:
            raise IndexError("row position out of range")
        at = first_rows(self.df, position + 1, self._order())
        keys = [F.max(F.struct(*self._order())).alias("k"), F.count("*").alias("n")]
        last = at.agg(*keys).first()
        if last["n"] != position + 1:
            raise IndexError("row position out of range")
        same = [F.col(k).eqNullSafe(F.lit(last["k"][k])) for k in self._order()]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        return self._with(self.df.where(~cond))

    def rename_column(self, old: str, new: str) -> Frame:
        self._known(old)
        if old == new:
            return self
        if not new or new in self.df.columns:
            raise ValueError(f"column name is blank or taken: {new!r}")
        return self._with(self.df.withColumnRenamed(old, new), [new if k == old else k for k in self.keys])

    def apply(self, name: str, f: Callable[[Column], Column]) -> Frame:
        self._known(name)
        return self._with(self.df.withColumn(name, f(F.col(name))))

    def apply_all(self, f: Callable[[Column], Column], names: Sequence[str] | None = None) -> Frame:
        chosen = set(names or [c for c in self._numeric() if c not in self.keys])
        return self._with(self.df.select(*[f(F.col(c)).alias(c) if c in chosen else F.col(c) for c in self.df.columns]))

    # rows

    def filter(self, predicate: Column | Callable[[Frame], Column]) -> Frame:
        """Rows where a Column predicate holds; it reaches the scan."""
        return self._with(self.df.where(predicate(self) if callable(predicate) else predicate))

    def filter_rows(self, keep: Callable) -> Frame:
        """Rows that an opaque function keeps: a batch (pandas frame) in, a boolean for each row out."""

        def run(batches):
            for b in batches:
                yield b[keep(b)]

        return self._with(self.df.mapInPandas(run, self.df.schema))

    def head(self, n: int = 5) -> Frame:
        return self._with(first_rows(self.df, n, self._order()))

    def tail(self, n: int = 5) -> Frame:
        return self._with(first_rows(first_rows(self.df, n, self._order(), last=True), n, self._order()))

    def slice(self, start: int, end: int) -> Frame:
        if not 0 <= start < end:
            raise ValueError("slice needs 0 <= start < end")
        return self._with(row_range(self.df, start, end, self._order()))

    def sort(self, name: str, ascending: bool = True) -> DataFrame:
        """All rows by one column, ties by keys."""
        self._known(name)
        c = F.col(name)
        return self.df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *self.keys)

    def positioned(self, name: str = "_rid") -> DataFrame:
        return with_position(self.df, self._order(), name)

    # missing values

    def fill_na(self, value: float) -> Frame:
        return self._with(self.df.fillna(value, subset=self._numeric()))

    def drop_na(self) -> Frame:
        return self._with(self.df.dropna(how="any"))

    def is_na(self) -> DataFrame:
        """(column, missing): NULLs and NaNs of each column."""
        return _long(self.df, {f.name: F.count_if(stats.present(f.name, f.dataType).isNull()) for f in self.df.schema.fields if f.name != "_rid"}, "missing", "long")

    def interpolate(self, names: Sequence[str], by: str, block: int = 1 << 16) -> Frame:
        """Gaps filled linearly in the order of a whole-number column; ends stay missing.

        The nearest known values are looked up within blocks of the order column, and across
        blocks by one row each, so no window spans the table. Blocks are as wide as ``block`` rows
        on average, so sparse order columns do not make more of them.
        """
        self._known(by, *names)
        ends = self.df.agg(F.count("*").alias("n"), F.min(by).alias("a"), F.max(by).alias("b")).first()
        width = max(1, -(-((ends["b"] or 0) - (ends["a"] or 0) + 1) * block // max(ends["n"], 1)))
        df = self.df.withColumn("__b", F.floor(F.col(by) / width))
        # a frame that starts at the block's edge grows row by row; one that ends there would be read anew for each row
        back = Window.partitionBy("__b").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy("__b").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
        for c in names:
            known = stats.present(c, self.df.schema[c].dataType)
            point = F.when(known.isNotNull(), F.struct(F.col(by).cast("double").alias("x"), known.cast("double").alias("y")))
            ends = df.groupBy("__b").agg(F.min(point).alias("first"), F.max(point).alias("last"))
            wb = Window.orderBy("__b")  # one row a block
            ends = ends.select("__b", F.last("last", True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("__p"), F.first("first", True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("__n"))
            df = df.join(ends, "__b", "left")
            lo = F.coalesce(F.last(point, True).over(back), F.col("__p"))
            hi = F.coalesce(F.last(point, True).over(ahead), F.col("__n"))
            df = df.withColumn("__lo", lo).withColumn("__hi", hi)
            x = F.col(by).cast("double")
            line = F.col("__lo.y") + (F.col("__hi.y") - F.col("__lo.y")) * (x - F.col("__lo.x")) / F.when(F.col("__hi.x") > F.col("__lo.x"), F.col("__hi.x") - F.col("__lo.x"))
            df = df.withColumn(c, F.coalesce(known.cast("double"), line)).drop("__lo", "__hi", "__p", "__n")
        return self._with(df.drop("__b"))

    # joins and stacking

    def merge(self, other: Frame, on: str, how: str = "inner") -> Frame:
        """Equi-join on one common key; other clashing names get _x and _y."""
        self._known(on)
        other._known(on)
        left, right = _suffixed(self.df, other.df, [on])
        return Frame(left.join(right, [on], _how(how)), [k for k in self.keys if k in left.columns])

    def join(self, other: Frame, left_on: str, right_on: str, how: str = "inner") -> Frame:
        """Equi-join on keys of different names."""
        self._known(left_on)
        other._known(right_on)
        if left_on == right_on:
            return self.merge(other, left_on, how)
        left, right = _suffixed(self.df, other.df, [])
        l_name = left_on if left_on in left.columns else f"{left_on}_x"
        r_name = right_on if right_on in right.columns else f"{right_on}_y"
        if _how(how) == "cross":
            return Frame(left.crossJoin(right))
        return Frame(left.join(right, left[l_name] == right[r_name], _how(how)))

    @staticmethod
    def concat(frames: Sequence[Frame], axis: str = "0") -> Frame:
        """Stack by rows ("0"), or side by side by position ("1")."""
        if not frames:
            raise ValueError("nothing to concatenate")
        if axis == "0":
            out = frames[0].df
            for f in frames[1:]:
                out = out.unionByName(f.df, allowMissingColumns=True)
            return frames[0]._with(out)
        out = frames[0].positioned("_rid")
        for f in frames[1:]:
            right = f.positioned("_rid")
            left, right = _suffixed(out, right, ["_rid"])
            out = left.join(right, "_rid", "full")
        return Frame(out, ["_rid"])

    # aggregation

    def stat(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """One row with a NaN-skipping statistic of each numeric column."""
        f = stats.STATISTICS[name]
        chosen = list(columns or self._numeric())
        self._known(*chosen)
        if name == "median":  # counted by ranges: an exact median as an aggregate holds all distinct values
            got = order_statistics(self.df, {c: stats.present(c, self.df.schema[c].dataType) for c in chosen}, [0.5])
            return self.df.sparkSession.range(1).select(*[F.lit(got[c][0] or 0.0).cast("double").alias(c) for c in chosen])
        return self.df.agg(*[f(stats.present(c, self.df.schema[c].dataType)).alias(c) for c in chosen])

    def mean(self, columns=None) -> DataFrame:
        return self.stat("mean", columns)

    def median(self, columns=None) -> DataFrame:
        return self.stat("median", columns)

    def stddev(self, columns=None) -> DataFrame:
        return self.stat("stddev", columns)

    def variance(self, columns=None) -> DataFrame:
        return self.stat("variance", columns)

    def min(self, columns=None) -> DataFrame:
        return self.stat("min", columns)

    def max(self, columns=None) -> DataFrame:
        return self.stat("max", columns)

    def value_counts(self, columns: Sequence[str] | None = None) -> DataFrame:
        """(column, value, n) for every value of every column, read in one pass."""
        names = list(columns or self.columns)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]))
        return self.df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))

    def group_by(self, key: str, agg: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
        """One aggregate, given as Column -> Column, of each other numeric column."""
        self._known(key)
        names = columns or [c for c in self._numeric() if c != key]
        return self.df.groupBy(key).agg(*[agg(F.col(c)).alias(c) for c in names])

    def group_apply(self, key: str, f: Callable, columns: Sequence[str] | None = None) -> DataFrame:
        """An opaque function of the values (a pandas series) of each other numeric column, by group.

        A group's values come to one task; an aggregate that Spark knows belongs into ``group_by``.
        """
        self._known(key)
        names = list(columns or [c for c in self._numeric() if c != key])
        self._known(*names)
        schema = T.StructType([self.df.schema[key], *[T.StructField(c, T.DoubleType()) for c in names]])

        def run(k, rows):
            import pandas as pd

            return pd.DataFrame([[k[0], *[float(f(rows[c])) for c in names]]], columns=[key, *names])

        return self.df.select(key, *names).groupBy(key).applyInPandas(run, schema)

    def pivot(self, index: str, columns: str, values: str, names: Sequence[object] | None = None) -> DataFrame:
        """Long to wide; a repeated (index, column) pair raises."""
        self._known(index, columns, values)
        cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot has repeated entries")).cast(self.df.schema[values].dataType)).otherwise(F.first(values))
        return self.df.groupBy(index).pivot(columns, list(names) if names is not None else None).agg(cell)

    def unique(self) -> Frame:
        return self._with(self.df.distinct())

    def drop_duplicates(self, subset: Sequence[str] = ()) -> Frame:
        """The first row by keys of each distinct subset; one aggregate with partial sums, no window."""
        names = list(subset) or self.columns
        self._known(*names)
        rest = [c for c in self.df.columns if c not in names]
        if not rest:
            return self._with(self.df.distinct())
        if not self.keys:
            raise ValueError("keeping the first of duplicates needs row order: give the frame key columns")
        lead = [k for k in self.keys if k in rest] or list(rest)
        packed = F.min_by(F.struct(*rest), F.struct(*lead)).alias("r")
        out = self.df.groupBy(*names).agg(packed).select(*names, *[F.col(f"r.{c}").alias(c) for c in rest])
        return self._with(out.select(*self.df.columns))

    # scaling and encoding

    def normalize(self, columns: Sequence[str], method: str = "minmax") -> Frame:
        """Columns to [0, 1] (minmax), less their mean by their deviation (zscore), or by their greatest size (max).

        A constant column becomes 0. What is needed of a column is one broadcast row.
        """
        if method not in ("minmax", "zscore", "max"):
            raise ValueError(f"unknown method: {method}")
        self._known(*columns)
        if method == "zscore":
            return self.standardize(columns)
        if method == "max":
            row = self.df.agg(*[F.max(F.abs(stats.present(c, self.df.schema[c].dataType))).alias(f"__most_{c}") for c in columns])
            out = self.df.join(F.broadcast(row))
            for c in columns:
                out = out.withColumn(c, F.when(F.col(f"__most_{c}") == 0, F.lit(0.0)).otherwise(F.col(c) / F.col(f"__most_{c}")))
            return self._with(out.drop(*row.columns))
        row = self.df.agg(*[g(stats.present(c, self.df.schema[c].dataType)).alias(f"__{n}_{c}") for c in columns for n, g in (("lo", F.min), ("hi", F.max))])
        out = self.df.join(F.broadcast(row))
        for c in columns:
            width = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
            out = out.withColumn(c, F.when(width == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__lo_{c}")) / F.when(width != 0, width)))
        return self._with(out.drop(*row.columns))

    def standardize(self, columns: Sequence[str]) -> Frame:
        """Columns less their mean, by their sample deviation; a constant column becomes 0."""
        self._known(*columns)
        row = self.df.agg(*[g(stats.present(c, self.df.schema[c].dataType)).alias(f"__{n}_{c}") for c in columns for n, g in (("m", F.avg), ("s", F.stddev_samp))])
        out = self.df.join(F.broadcast(row))
        for c in columns:
            s = F.col(f"__s_{c}")
            out = out.withColumn(c, F.when(F.coalesce(s, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.when(s != 0, s)))
        return self._with(out.drop(*row.columns))

    def one_hot_encode(self, column: str, most: int = 10_000) -> Frame:
        """Indicator columns for the sorted distinct values, which must be few enough to be columns."""
        self._known(column)
        values = [r[0] for r in self.df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError("too many distinct values for indicator columns")
        out = self.df.select("*", *[F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in sorted(values)])
        return self._with(out.drop(column))

    # arrays

    def to_matrix(self, columns: Sequence[str] | None = None):
        """Rows x columns array by row position; an empty frame gives an empty array."""
        from gridloom.operators.array import NDArray

        names = list(columns or [c for c in self._numeric()])
        at = self.positioned("__i")
        cells = at.select(F.col("__i").alias("i0"), F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("i1", "v"))
        return NDArray(cells.withColumn("i1", F.col("i1").cast("long")), (self.rows(), len(names)))

    @classmethod
    def from_matrix(cls, matrix, names: Sequence[str]) -> Frame:
        if len(matrix.shape) != 2 or matrix.shape[1] != len(names):
            raise ValueError("one name is needed for each column of a 2-D array")
        _check_names(names)
        wide = matrix.df.groupBy("i0").agg(*[F.max(F.when(F.col("i1") == j, F.col("v"))).alias(n) for j, n in enumerate(names)])
        return cls(wide.withColumnRenamed("i0", "_rid"), ["_rid"])


def _check_names(names: Sequence[str]) -> None:
    if any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError("column names must be distinct and not blank")


def _how(how: str) -> str:
    if how not in JOINS:
        raise ValueError(f"unknown join kind: {how}")
    return JOINS[how]


def _suffixed(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    clash = (set(left.columns) & set(right.columns)) - set(on)
    mark = lambda df, s: df.select(*[F.col(c).alias(c + s) if c in clash else F.col(c) for c in df.columns])
    return mark(left, "_x"), mark(right, "_y")


def _long(df: DataFrame, measures: Mapping[str, Column], value: str, kind: str) -> DataFrame:
    """One aggregate row as (column, value) rows."""
    row = df.agg(*[m.cast(kind).alias(f"m{i}") for i, m in enumerate(measures.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"m{i}").alias(value)) for i, n in enumerate(measures)])).alias("r")).select("r.*")
