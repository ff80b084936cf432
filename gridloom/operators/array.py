"""N-dimensional arrays as coordinate tables.

An ``NDArray`` is a DataFrame of coordinates ``i0 .. i{r-1}`` and values ``v``, one row
for every cell (zeros are explicit), with its shape as Python metadata. Reshaping is a
projection of coordinates; reductions are grouped aggregates with partial sums; scans
and sorts are cut into blocks or ranges, so no window holds a whole array in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import elementwise as E
from gridloom.functions.quantiles import order_statistics
from gridloom.operators.order import with_position
from gridloom.sources.scratch import staged

#: Most cells that may be collected for algebra or a list on the driver.
DRIVER_CELLS = 4_000_000
#: Cells along an axis that one window partition of a scan holds.
SCAN_BLOCK = 1 << 16


def _i(k: int) -> str:
    return f"i{k}"


class NDArray:
    """A dense array of any rank over (i0, .., v) rows."""

    def __init__(self, df: DataFrame, shape: Sequence[int]):
        if any(s < 0 for s in shape):
            raise ValueError("dimensions must not be negative")
        self.shape = tuple(int(s) for s in shape)
        self.df = df.select(*[F.col(_i(k)).cast("long").alias(_i(k)) for k in range(len(self.shape))], "v")

    # construction

    @classmethod
    def _range(cls, spark: SparkSession, shape: Sequence[int], value: Callable[..., Column]) -> NDArray:
        shape = tuple(shape)
        if not shape or any(s <= 0 for s in shape):
            raise ValueError("dimensions must be positive")
        flat = spark.range(prod(shape))
        coords = _unflatten(F.col("id"), shape)
        return cls(flat.select("id", *[c.alias(_i(k)) for k, c in enumerate(coords)]).withColumn("v", value(F.col("id"), *[F.col(_i(k)) for k in range(len(shape))])), shape)

    @classmethod
    def full(cls, spark: SparkSession, shape: Sequence[int], value: float) -> NDArray:
        return cls._range(spark, shape, lambda *_: F.lit(float(value)))

    @classmethod
    def zeros(cls, spark: SparkSession, shape: Sequence[int]) -> NDArray:
        return cls.full(spark, shape, 0.0)

    @classmethod
    def ones(cls, spark: SparkSession, shape: Sequence[int]) -> NDArray:
        return cls.full(spark, shape, 1.0)

    @classmethod
    def eye(cls, spark: SparkSession, n: int) -> NDArray:
        return cls._range(spark, (n, n), lambda _, i, j: F.when(i == j, 1.0).otherwise(0.0))

    @classmethod
    def random(cls, spark: SparkSession, shape: Sequence[int], low: float = 0.0, high: float = 1.0, seed: int = 0, integer: bool = False) -> NDArray:
        """Uniform values; whole numbers include both ends. A seed gives the same numbers on the same partitioning."""
        if integer:
            return cls._range(spark, shape, lambda *_: (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("double"))
        return cls._range(spark, shape, lambda *_: F.rand(seed) * (high - low) + low)

    @classmethod
    def arange(cls, spark: SparkSession, start: float, end: float, step: float = 1.0) -> NDArray:
        if step == 0:
            raise ValueError("step must not be zero")
        n = -int(-((end - start) / step) // 1)
        if n <= 0:
            raise ValueError("the progression is empty")
        return cls._range(spark, (n,), lambda _, i: F.lit(float(start)) + i * F.lit(float(step)))

    @classmethod
    def linspace(cls, spark: SparkSession, start: float, stop: float, num: int) -> NDArray:
        if num <= 0:
            raise ValueError("num must be positive")
        step = (stop - start) / (num - 1) if num > 1 else 0.0
        return cls._range(spark, (num,), lambda _, i: F.lit(float(start)) + i * F.lit(step))

    @classmethod
    def literal(cls, spark: SparkSession, values: Sequence) -> NDArray:
        """A small array of nested lists."""
        shape, at = [], values
        while isinstance(at, (list, tuple)):
            shape.append(len(at))
            at = at[0] if at else 0.0
        if any(s == 0 for s in shape):
            raise ValueError("dimensions must be positive")
        rows: list[tuple] = []

        def walk(x, idx: tuple[int, ...]) -> None:
            if len(idx) == len(shape):
                rows.append((*idx, float(x)))
                return
            if len(x) != shape[len(idx)]:
                raise ValueError("rows are not equally long")
            for k, y in enumerate(x):
                walk(y, (*idx, k))

        walk(values, ())
        return cls(spark.createDataFrame(rows, ", ".join([*(f"{_i(k)} long" for k in range(len(shape)))]) + ", v double"), shape)

    @classmethod
    def of_columns(cls, df: DataFrame, row: str, columns: Sequence[str], rows: int) -> NDArray:
        """Wide rows numbered by ``row`` as a 2-D array."""
        cells = df.select(F.col(row).alias("i0"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("i1", "v"))
        return cls(cells, (rows, len(columns)))

    @classmethod
    def diag(cls, vector: NDArray, k: int = 0) -> NDArray:
        """Square array with the vector on diagonal k."""
        if vector.ndim != 1:
            raise ValueError("diag needs a vector")
        n = vector.shape[0] + abs(k)
        spots = vector.df.select((F.col("i0") + max(-k, 0)).alias("i0"), (F.col("i0") + max(k, 0)).alias("i1"), F.col("v").alias("d"))
        return cls.zeros(vector.df.sparkSession, (n, n))._patched(spots)

    def _patched(self, spots: DataFrame) -> NDArray:
        keys = [_i(k) for k in range(self.ndim)]
        return NDArray(self.df.join(spots, keys, "left").withColumn("v", F.coalesce("d", "v")), self.shape)

    # metadata and access

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        """Row-major cells between neighbours along each axis."""
        return tuple(prod(self.shape[k + 1 :]) for k in range(self.ndim))

    @property
    def empty(self) -> bool:
        return self.size == 0 or not self.shape

    def offset(self, index: Sequence[int]) -> int:
        """Row-major place of an index."""
        if len(index) != self.ndim or any(not 0 <= i < s for i, s in zip(index, self.shape, strict=True)):
            raise IndexError("index does not fit the shape")
        return reduce(lambda acc, x: acc * x[1] + x[0], zip(index, self.shape, strict=True), 0)

    def at(self, *index: int) -> float:
        self.offset(index)
        cond = reduce(lambda a, b: a & b, [F.col(_i(k)) == x for k, x in enumerate(index)])
        return self.df.where(cond).first()["v"]

    def flat(self) -> Column:
        return reduce(lambda acc, k: acc * self.shape[k] + F.col(_i(k)), range(1, self.ndim), F.col("i0"))

    def to_list(self) -> list:
        """The whole array on the driver; of at most DRIVER_CELLS cells."""
        if self.size > DRIVER_CELLS:
            raise ValueError(f"an array of {self.size} cells is too large for the driver")
        flat = [r[1] for r in sorted(self.df.select(self.flat().alias("f"), "v").collect())]

        def fold(xs: list, dims: Sequence[int]) -> list:
            if len(dims) <= 1:
                return xs
            w = len(xs) // dims[0]
            return [fold(xs[i * w : (i + 1) * w], dims[1:]) for i in range(dims[0])]

        return fold(flat, self.shape)

    def __str__(self) -> str:
        if self.ndim > 2:
            return f"array of shape {self.shape}"
        if self.ndim == 1:
            return "[" + ", ".join(f"{x:g}" for x in self.to_list()) + "]"
        return "\n".join("".join(f"{x:8g}" for x in row) for row in self.to_list())

    def as_type(self, kind: str) -> NDArray:
        """Cast of every value; fractions are cut toward zero."""
        return NDArray(self.df.withColumn("v", F.col("v").cast(kind)), self.shape)

    def _two(self, what: str) -> tuple[int, int]:
        if self.ndim != 2:
            raise ValueError(f"{what} needs a 2-D array")
        return self.shape

    def _axis(self, axis: int) -> int:
        if not -self.ndim <= axis < self.ndim:
            raise ValueError("no such axis")
        return axis % self.ndim

    # elementwise

    def map(self, f: Callable[[Column], Column]) -> NDArray:
        return NDArray(self.df.withColumn("v", f(F.col("v"))), self.shape)

    def fill(self, value: float) -> NDArray:
        return self.map(lambda _: F.lit(float(value)))

    def zip(self, other: NDArray, f: Callable[[Column, Column], Column]) -> NDArray:
        """Cell by cell with an array of the same shape, or one that broadcasts to a common shape.

        Axes of length 1 (and missing leading ones) are not joined on.
        """
        shape = broadcast_shape(self.shape, other.shape)
        a, b = self._padded(len(shape)), other._padded(len(shape))
        common = [k for k in range(len(shape)) if a.shape[k] == b.shape[k]]
        left, right = a.df.withColumnRenamed("v", "a"), b.df.withColumnRenamed("v", "b")
        cols = []
        for k in range(len(shape)):
            if k in common:
                cols.append(F.col(_i(k)))
            else:
                cols.append((left if a.shape[k] == shape[k] else right)[_i(k)].alias(_i(k)))
        keys = [_i(k) for k in common if shape[k] > 1]
        joined = left.join(right, [left[k] == right[k] for k in keys]) if keys else left.crossJoin(right)
        picked = [left[_i(k)].alias(_i(k)) if k in common else c for k, c in enumerate(cols)]
        return NDArray(joined.select(*picked, f(F.col("a"), F.col("b")).alias("v")), shape)

    def _padded(self, rank: int) -> NDArray:
        lead = rank - self.ndim
        cols = [F.lit(0).cast("long").alias(_i(k)) for k in range(lead)] + [F.col(_i(k)).alias(_i(k + lead)) for k in range(self.ndim)]
        return NDArray(self.df.select(*cols, "v"), (1,) * lead + self.shape)

    def _binary(self, other, f: Callable[[Column, Column], Column]) -> NDArray:
        if isinstance(other, NDArray):
            if self.shape != other.shape:
                raise ValueError("shapes differ; use zip() to broadcast")
            return self.zip(other, f)
        return self.map(lambda v: f(v, F.lit(float(other))))

    def __add__(self, other):
        return self._binary(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._binary(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._binary(other, lambda a, b: a * b)

    def __truediv__(self, other):
        if not isinstance(other, NDArray) and other == 0:
            raise ZeroDivisionError("division by zero")
        return self._binary(other, lambda a, b: a / b)  # a zero cell raises under ANSI

    def __radd__(self, s):
        return self.map(lambda v: F.lit(float(s)) + v)

    def __rsub__(self, s):
        return self.map(lambda v: F.lit(float(s)) - v)

    def __rmul__(self, s):
        return self.map(lambda v: F.lit(float(s)) * v)

    def __pos__(self):
        return self

    def __neg__(self):
        return self.map(lambda v: -v)

    def equals(self, other: NDArray) -> bool:
        """Same shape and cells; NaN equals nothing."""
        if self.shape != other.shape:
            return False
        keys = [_i(k) for k in range(self.ndim)]
        both = self.df.withColumnRenamed("v", "a").join(other.df.withColumnRenamed("v", "b"), keys, "full")
        same = (F.col("a") == F.col("b")) & ~F.isnan("a")
        return both.where(~F.coalesce(same, F.lit(False))).isEmpty()

    def isnan(self) -> NDArray:
        return self.map(E.is_nan)

    def isinf(self) -> NDArray:
        return self.map(E.is_inf)

    def isfinite(self) -> NDArray:
        return self.map(E.is_finite)

    def broadcastable(self, other: NDArray) -> bool:
        try:
            broadcast_shape(self.shape, other.shape)
        except ValueError:
            return False
        return True

    def broadcast_to(self, shape: Sequence[int]) -> NDArray:
        return NDArray.zeros(self.df.sparkSession, shape).zip(self, lambda _, b: b)

    def normalize(self, eps: float = 1e-8) -> NDArray:
        """All cells by their common L2 norm, which must reach eps."""
        norm = self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        checked = norm.select(F.when(F.col("norm") >= eps, F.col("norm")).otherwise(F.raise_error(F.lit("the norm is too small")).cast("double")).alias("norm"))
        return NDArray(self.df.join(F.broadcast(checked)).withColumn("v", F.col("v") / F.col("norm")), self.shape)

    def standardize(self) -> NDArray:
        """All cells less their mean, by their sample deviation."""
        row = self.df.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
        return NDArray(self.df.join(F.broadcast(row)).withColumn("v", (F.col("v") - F.col("m")) / F.col("s")), self.shape)

    # reductions

    def reduce(self, agg: Callable[[Column], Column], axis: int | None = None) -> NDArray | DataFrame:
        """One row over all cells, or an array without the axis."""
        if self.empty:
            raise ValueError("nothing to reduce")
        if axis is None:
            return self.df.agg(agg(F.col("v")).alias("v"))
        axis = self._axis(axis)
        rest = [k for k in range(self.ndim) if k != axis]
        if not rest:
            return self.df.agg(agg(F.col("v")).alias("v"))
        out = self.df.groupBy(*[_i(k) for k in rest]).agg(agg(F.col("v")).alias("v"))
        names = [F.col(_i(k)).alias(_i(n)) for n, k in enumerate(rest)]
        return NDArray(out.select(*names, "v"), [self.shape[k] for k in rest])

    def sum(self, axis=None):
        return self.reduce(F.sum, axis)

    def max(self, axis=None):
        return self.reduce(F.max, axis)

    def min(self, axis=None):
        return self.reduce(F.min, axis)

    def mean(self, axis=None):
        return self.reduce(F.avg, axis)

    def variance(self, axis=None):
        """Sample variance; fewer than two cells raise."""
        if (self.size if axis is None else self.shape[self._axis(axis)]) < 2:
            raise ValueError("variance needs two values")
        return self.reduce(F.var_samp, axis)

    def standard_deviation(self, axis=None):
        if (self.size if axis is None else self.shape[self._axis(axis)]) < 2:
            raise ValueError("deviation needs two values")
        return self.reduce(F.stddev_samp, axis)

    def median(self, axis=None):
        return self._quantile(0.5, axis)

    def _quantile(self, share: float, axis):
        """Values between the two middle ranks, by line. An aggregate's state holds at most the cells
        along the axis; where these are many, ranks are counted by ranges or taken from one sort.
        """
        length = self.size if axis is None or self.ndim == 1 else self.shape[self._axis(axis)]
        if length <= SCAN_BLOCK:
            return self.reduce(lambda v: F.percentile(v, F.lit(share)), axis)
        if length == self.size:
            got = order_statistics(self.df, {"v": F.col("v")}, [share])["v"][0]
            return self.df.sparkSession.range(1).select(F.lit(got).cast("double").alias("v"))
        ranked, _ = self._ranked(self._axis(axis))
        at = share * (length - 1)
        low, part = int(at), at - int(at)
        weight = F.when(F.col("rank") == low, 1 - part).when(F.col("rank") == low + 1, part)
        return NDArray(ranked.where(F.col("rank").isin(low, low + 1)).withColumn("v", F.col("v") * weight), self.shape).sum(axis)

    def percentile(self, p: float, axis=None):
        if not 0 <= p <= 100:
            raise ValueError("percentile must be within 0 and 100")
        return self._quantile(p / 100, axis)

    def any(self, axis=None):
        return self.reduce(lambda v: F.bool_or(v != 0), axis)

    def all(self, axis=None):
        return self.reduce(lambda v: F.bool_and(v != 0), axis)

    def _arg(self, axis: int | None, largest: bool):
        """First index of the extreme; ties go to the smallest index."""
        place = self.flat() if axis is None else F.col(_i(self._axis(axis)))
        pick = F.max_by(F.col("p"), F.struct("v", -F.col("p"))) if largest else F.min_by(F.col("p"), F.struct("v", "p"))
        return NDArray(self.df, self.shape)._placed(place).reduce_placed(pick, axis)

    def _placed(self, place: Column) -> _Placed:
        return _Placed(self, self.df.withColumn("p", place))

    def argmax(self, axis=None):
        return self._arg(axis, True)

    def argmin(self, axis=None):
        return self._arg(axis, False)

    def trace(self) -> DataFrame:
        n, m = self._two("trace")
        if n != m:
            raise ValueError("trace needs a square array")
        return self.df.where("i0 = i1").agg(F.sum("v").alias("v"))

    def histogram(self, bins: int = 10) -> NDArray:
        """Counts of equally wide bins between the extremes, the last one closed; constant data fill bin 0."""
        ends = self.df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
        counted = self.df.join(F.broadcast(ends)).select(at.cast("long").alias("i0")).groupBy("i0").agg(F.count("*").cast("double").alias("d"))
        return NDArray.zeros(self.df.sparkSession, (bins,))._patched(counted)

    def bincount(self) -> NDArray:
        """Counts of 0 .. max of whole non-negative numbers."""
        ends = self.df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.col("v") == F.floor("v")).alias("whole")).first()
        if ends["lo"] is None or ends["lo"] < 0 or not ends["whole"]:
            raise ValueError("bincount needs whole non-negative numbers")
        counted = self.df.groupBy(F.col("v").cast("long").alias("i0")).agg(F.count("*").cast("double").alias("d"))
        return NDArray.zeros(self.df.sparkSession, (int(ends["hi"]) + 1,))._patched(counted)

    def digitize(self, edges: Sequence[float]) -> NDArray:
        """Number of sorted edges that do not exceed each value."""
        if list(edges) != sorted(edges):
            raise ValueError("edges must be sorted")
        lits = F.array(*[F.lit(float(e)) for e in edges]) if len(edges) > 64 else None
        if lits is not None:
            return self.map(lambda v: F.size(F.filter(lits, lambda e: e <= v)).cast("long"))
        return self.map(lambda v: sum(((v >= float(e)).cast("long") for e in edges), F.lit(0).cast("long")))

    # scans and stencils along an axis

    def _scan(self, axis: int, op: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> NDArray:
        """Running value within blocks of the axis, then with what the blocks before give."""
        axis = self._axis(axis)
        rest = [_i(k) for k in range(self.ndim) if k != axis]
        blocked = self.df.withColumn("b", F.floor(F.col(_i(axis)) / SCAN_BLOCK))
        w = Window.partitionBy(*rest, "b").orderBy(_i(axis)).rowsBetween(Window.unboundedPreceding, 0)
        inside = blocked.withColumn("s", op(F.col("v")).over(w))
        if self.shape[axis] <= SCAN_BLOCK:
            return NDArray(inside.select(*[_i(k) for k in range(self.ndim)], F.col("s").alias("v")), self.shape)
        totals = blocked.groupBy(*rest, "b").agg(op(F.col("v")).alias("t"))
        before = Window.partitionBy(*rest).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*rest, "b", op(F.col("t")).over(before).alias("c"))
        out = inside.join(carried, [*rest, "b"], "left")
        return NDArray(out.select(*[_i(k) for k in range(self.ndim)], F.when(F.col("c").isNull(), F.col("s")).otherwise(combine(F.col("c"), F.col("s"))).alias("v")), self.shape)

    def cumsum(self, axis: int = 0) -> NDArray:
        return self._scan(axis, F.sum, lambda a, b: a + b)

    def cumprod(self, axis: int = 0) -> NDArray:
        return self._scan(axis, F.product, lambda a, b: a * b)

    def _moved(self, axis: int, by: int, name: str) -> DataFrame:
        return self.df.select(*[(F.col(_i(k)) + (by if k == axis else 0)).alias(_i(k)) for k in range(self.ndim)], F.col("v").alias(name))

    def diff(self, n: int = 1, axis: int = 0) -> NDArray:
        """Differences at lag n, as one equi-join of the array with itself moved."""
        axis = self._axis(axis)
        if n <= 0:
            raise ValueError("the lag must be positive")
        if self.shape[axis] <= n:
            return NDArray.zeros(self.df.sparkSession, (1,))
        keys = [_i(k) for k in range(self.ndim)]
        out = self.df.join(self._moved(axis, -n, "ahead"), keys).withColumn("v", F.col("ahead") - F.col("v"))
        return NDArray(out, [s - n if k == axis else s for k, s in enumerate(self.shape)])

    def gradient(self, spacing: float = 1.0) -> NDArray:
        """Central differences, one-sided at both ends, of a vector."""
        if self.ndim != 1:
            raise ValueError("gradient needs a vector")
        if spacing == 0:
            raise ValueError("spacing must not be zero")
        n = self.shape[0]
        if n == 1:
            return self.fill(0.0)
        out = self.df.join(self._moved(0, 1, "back"), ["i0"], "left").join(self._moved(0, -1, "ahead"), ["i0"], "left")
        v = F.when(F.col("back").isNull(), (F.col("ahead") - F.col("v")) / spacing).when(F.col("ahead").isNull(), (F.col("v") - F.col("back")) / spacing).otherwise((F.col("ahead") - F.col("back")) / (2 * spacing))
        return NDArray(out.withColumn("v", v), self.shape)

    def trapz(self, x: NDArray | None = None, axis: int = -1):
        """Trapezoid integral over x, by default over unit steps."""
        axis = self._axis(axis)
        if x is not None and x.shape != self.shape:
            raise ValueError("x and y must have one shape")
        keys = [_i(k) for k in range(self.ndim)]
        both = self.df.withColumn("x", F.col(_i(axis)).cast("double")) if x is None else self.df.join(x.df.withColumnRenamed("v", "x"), keys)
        ahead = both.select(*[(F.col(_i(k)) - (1 if k == axis else 0)).alias(_i(k)) for k in range(self.ndim)], F.col("x").alias("x2"), F.col("v").alias("v2"))
        area = both.join(ahead, keys).withColumn("v", (F.col("x2") - F.col("x")) * (F.col("v") + F.col("v2")) / 2)
        return NDArray(area, [s - (k == axis) for k, s in enumerate(self.shape)]).sum(axis)

    # sorting

    def _ranked(self, axis: int | None) -> tuple[DataFrame, int]:
        """Cells in sorted order along an axis with their rank, from one global range sort."""
        rest = [] if axis is None else [_i(k) for k in range(self.ndim) if k != axis]
        src = self.df.withColumn("f", self.flat())
        length = self.size if axis is None else self.shape[axis]
        ranked = with_position(src, [*rest, "v", "f"], "pos").withColumn("rank", F.col("pos") % length)
        return ranked, length

    def sort(self, axis: int | None = None) -> NDArray:
        axis = None if axis is None else self._axis(axis)
        ranked, _ = self._ranked(axis)
        if axis is None:
            return NDArray(ranked.select(*[c.alias(_i(k)) for k, c in enumerate(_unflatten(F.col("pos"), self.shape))], "v"), self.shape)
        return NDArray(ranked.withColumn(_i(axis), F.col("rank")), self.shape)

    def argsort(self, axis: int | None = None) -> NDArray:
        """Index along the axis (or flat index) of the cell at each rank; ties by index."""
        axis = None if axis is None else self._axis(axis)
        ranked, _ = self._ranked(axis)
        if axis is None:
            return NDArray(ranked.select(F.col("pos").alias("i0"), F.col("f").alias("v")), (self.size,))
        return NDArray(ranked.withColumn("v", F.col(_i(axis))).withColumn(_i(axis), F.col("rank")), self.shape)

    # reshaping

    def _coords(self, coords: Sequence[Column], shape: Sequence[int]) -> NDArray:
        return NDArray(self.df.select(*[c.alias(_i(k)) for k, c in enumerate(coords)], "v"), shape)

    def reshape(self, shape: Sequence[int]) -> NDArray:
        if prod(shape) != self.size:
            raise ValueError("the sizes differ")
        return self._coords(_unflatten(self.flat(), tuple(shape)), shape)

    def flatten(self) -> NDArray:
        return self.reshape((self.size,))

    def transpose(self, axes: Sequence[int] | None = None) -> NDArray:
        order = list(axes) if axes else list(range(self.ndim))[::-1]
        if sorted(order) != list(range(self.ndim)):
            raise ValueError("axes must be a permutation")
        return self._coords([F.col(_i(a)) for a in order], [self.shape[a] for a in order])

    def swapaxes(self, a: int, b: int) -> NDArray:
        order = list(range(self.ndim))
        a, b = self._axis(a), self._axis(b)
        order[a], order[b] = order[b], order[a]
        return self.transpose(order)

    def rotate90(self, k: int = 1) -> NDArray:
        """k clockwise quarter turns."""
        n, m = self._two("rotate90")
        i, j = F.col("i0"), F.col("i1")
        turns = {0: ([i, j], (n, m)), 1: ([j, n - 1 - i], (m, n)), 2: ([n - 1 - i, m - 1 - j], (n, m)), 3: ([m - 1 - j, i], (m, n))}
        return self._coords(*turns[k % 4])

    def flip(self, horizontal: bool = True) -> NDArray:
        n, m = self._two("flip")
        i, j = F.col("i0"), F.col("i1")
        return self._coords([i, m - 1 - j] if horizontal else [n - 1 - i, j], self.shape)

    def slice(self, ranges: Sequence[tuple[int, int]]) -> NDArray:
        """Sub-block [a, b) of each axis."""
        if len(ranges) != self.ndim or any(not 0 <= a < b <= s for (a, b), s in zip(ranges, self.shape, strict=True)):
            raise ValueError("ranges do not fit the shape")
        cond = reduce(lambda x, y: x & y, [(F.col(_i(k)) >= a) & (F.col(_i(k)) < b) for k, (a, b) in enumerate(ranges)])
        inner = NDArray(self.df.where(cond), self.shape)
        return inner._coords([F.col(_i(k)) - a for k, (a, _) in enumerate(ranges)], [b - a for a, b in ranges])

    def concatenate(self, other: NDArray, axis: int = 0) -> NDArray:
        axis = self._axis(axis)
        if self.ndim != other.ndim or any(a != b for k, (a, b) in enumerate(zip(self.shape, other.shape, strict=True)) if k != axis):
            raise ValueError("shapes do not fit")
        moved = other._moved(axis, self.shape[axis], "v")
        return NDArray(self.df.unionByName(moved), [s + (other.shape[k] if k == axis else 0) for k, s in enumerate(self.shape)])

    def stack(self, other: NDArray, axis: int = 0) -> NDArray:
        if self.shape != other.shape:
            raise ValueError("shapes differ")
        return self.expand_dims(axis).concatenate(other.expand_dims(axis), axis)

    def split(self, sections: int, axis: int = 0) -> list[NDArray]:
        axis = self._axis(axis)
        if sections <= 0 or self.shape[axis] % sections:
            raise ValueError("the axis does not divide evenly")
        w = self.shape[axis] // sections
        return [self.slice([(s * w, (s + 1) * w) if k == axis else (0, n) for k, n in enumerate(self.shape)]) for s in range(sections)]

    def repeat(self, repeats: int, axis: int | None = 0) -> NDArray:
        """Each cell (axis None) or each slice of an axis, repeated in place."""
        if repeats <= 0:
            raise ValueError("repeats must be positive")
        base = self.flatten() if axis is None else self
        axis = 0 if axis is None else self._axis(axis)
        more = base.df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(_i(axis), F.col(_i(axis)) * repeats + F.col("r"))
        return NDArray(more, [s * repeats if k == axis else s for k, s in enumerate(base.shape)])

    def expand_dims(self, axis: int) -> NDArray:
        if not 0 <= axis <= self.ndim:
            raise ValueError("no such axis")
        cols = [F.col(_i(k)) for k in range(self.ndim)]
        return self._coords(cols[:axis] + [F.lit(0).cast("long")] + cols[axis:], self.shape[:axis] + (1,) + self.shape[axis:])

    def squeeze(self) -> NDArray:
        keep = [k for k, s in enumerate(self.shape) if s != 1] or [0]
        return self._coords([F.col(_i(k)) for k in keep], [self.shape[k] for k in keep])

    def pad(self, widths: Sequence[tuple[int, int]], mode: str = "constant", value: float = 0.0) -> NDArray:
        """Margins before and after each axis: a constant, or the nearest edge cell."""
        if len(widths) != self.ndim or mode not in ("constant", "edge"):
            raise ValueError("one pair of widths is needed for each axis, and mode constant or edge")
        shape = [s + a + b for s, (a, b) in zip(self.shape, widths, strict=True)]
        if mode == "constant":
            spots = self.df.select(*[(F.col(_i(k)) + a).alias(_i(k)) for k, (a, _) in enumerate(widths)], F.col("v").alias("d"))
            return NDArray.full(self.df.sparkSession, shape, value)._patched(spots)
        df = self.df
        for k, (a, b) in enumerate(widths):  # edge cells are copied outwards, axis by axis: no join
            c, n = F.col(_i(k)), self.shape[k]
            lo, hi = F.when(c == 0, F.lit(0)).otherwise(c + a), F.when(c == n - 1, F.lit(n + a + b - 1)).otherwise(c + a)
            df = df.withColumn(_i(k), F.explode(F.sequence(lo, hi)))
        return NDArray(df, shape)

    # predicates

    def is_square(self) -> bool:
        return self.ndim == 2 and self.shape[0] == self.shape[1]

    def is_symmetric(self) -> bool:
        return self.is_square() and self.equals(self.transpose())

    def is_diagonal(self) -> bool:
        return self.is_square() and self.df.where((F.col("i0") != F.col("i1")) & (F.col("v") != 0)).isEmpty()

    def optimize_layout(self) -> NDArray:
        """Cells in row-major ranges, written so: what later positional work reads in order."""
        keys = [_i(k) for k in range(self.ndim)]
        return NDArray(staged(self.df.repartitionByRange(*keys).sortWithinPartitions(*keys), "array"), self.shape)


class _Placed:
    """An array with a place column, for arg-extremes."""

    def __init__(self, array: NDArray, df: DataFrame):
        self.array, self.df = array, df

    def reduce_placed(self, pick: Column, axis: int | None):
        a = self.array
        if axis is None or a.ndim == 1:
            return self.df.agg(pick.alias("v"))
        axis = a._axis(axis)
        rest = [k for k in range(a.ndim) if k != axis]
        out = self.df.groupBy(*[_i(k) for k in rest]).agg(pick.alias("v"))
        return NDArray(out.select(*[F.col(_i(k)).alias(_i(n)) for n, k in enumerate(rest)], "v"), [a.shape[k] for k in rest])


def broadcast_shape(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    """Common shape of two arrays: axes align from the last, and length 1 stretches."""
    rank = max(len(a), len(b))
    a, b = (1,) * (rank - len(a)) + tuple(a), (1,) * (rank - len(b)) + tuple(b)
    if any(x != y and 1 not in (x, y) for x, y in zip(a, b, strict=True)):
        raise ValueError(f"shapes do not broadcast: {a}, {b}")
    return tuple(max(x, y) for x, y in zip(a, b, strict=True))


def _unflatten(flat: Column, shape: Sequence[int]) -> list[Column]:
    out: list[Column] = []
    stride = 1
    for s in reversed(shape):
        out.append((F.call_function("div", flat, F.lit(stride)) if stride > 1 else flat) % s)
        stride *= s
    return out[::-1]


def correlation(a: NDArray, b: NDArray) -> DataFrame:
    """Pearson correlation of the cells of two arrays."""
    if a.shape != b.shape:
        raise ValueError("shapes differ")
    keys = [_i(k) for k in range(a.ndim)]
    return a.df.join(b.df.withColumnRenamed("v", "w"), keys).agg(F.corr("v", "w").alias("v"))
