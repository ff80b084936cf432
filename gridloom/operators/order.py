"""Row identity: positions for operators whose meaning depends on row order.

Rows of a Spark table have no order, so every positional operator names key columns
that order them totally. Positions are given without a one-task window: rows are
range-partitioned and sorted by the keys, and each partition's offset is the number
of rows before it (one count per partition reaches the driver). The placed rows are
written once, so positions stay the same whatever is lost or asked for again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import staged

#: Largest result that a top-k plan (one heap per task) is used for; beyond it positions are used.
TOP_ROWS = 100_000


def as_columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def with_position(df: DataFrame, keys: Sequence[str | Column], name: str = "_rid") -> DataFrame:
    """df with ``name``: 0, 1, 2 ... in the order of keys, computed in parallel."""
    keys = as_columns(keys)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = staged(placed, "placed")  # both uses must see one partitioning
    part = F.shiftright("__at", 33)
    counts = dict(placed.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, {}
    for p in sorted(counts):
        offsets[p] = before
        before += counts[p]
    within = F.col("__at") - F.shiftleft(part, 33)
    if not offsets:
        return placed.withColumn(name, within).drop("__at")
    begins = df.sparkSession.createDataFrame(list(offsets.items()), "__part long, __begin long")  # two numbers a partition
    out = [c for c in placed.columns if c not in ("__at", name)]
    return placed.withColumn("__part", part).join(F.broadcast(begins), "__part").select(*[F.col(f"`{c}`") for c in out], (within + F.col("__begin")).alias(name))


def first_rows(df: DataFrame, n: int, keys: Sequence[str | Column], last: bool = False) -> DataFrame:
    """The first (or last) n rows by keys: one top-k plan for few, positions for many."""
    cols = as_columns(keys)
    if n > TOP_ROWS:
        if last:
            cols = [c.desc_nulls_last() for c in cols]
        return with_position(df, cols, "__pos").where(F.col("__pos") < n).drop("__pos")
    if last:
        cols = [c.desc_nulls_last() for c in cols]
    return df.orderBy(*cols).limit(n)


def row_range(df: DataFrame, start: int, end: int, keys: Sequence[str | Column]) -> DataFrame:
    """Rows start <= position < end."""
    if end <= TOP_ROWS:
        return df.orderBy(*as_columns(keys)).offset(start).limit(end - start)
    return with_position(df, keys, "__pos").where((F.col("__pos") >= start) & (F.col("__pos") < end)).drop("__pos")
