"""Exact order statistics of whole columns, by counting ranges: no sort, and no state that grows with the data.

Every wanted rank has a range of values that holds it, at first the whole column's. A pass
counts the values of each range in ``CELLS`` equal cells, and the cell that holds the rank
becomes its range. Once few values are left in it they are fetched. A pass narrows a range
four-thousandfold, so a handful of passes settles any column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4096
#: Values of a range that are fetched instead of counted again.
FEW = 20_000
#: Infinite values are counted with the largest finite ones.
MOST = 1.7976931348623157e308


def order_statistics(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its values at the shares of the way from the least to the greatest, between neighbours by line.

    Columns must be numbers without NaN; NULLs are passed over, and a column without values gives None.
    """
    names = list(columns)
    data = df.select(*[columns[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    ends = data.agg(*[f(f"c{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    wanted = {i: sorted({r for s in shares for r in _ranks(ends[f"n{i}"], s)}) for i in range(len(names)) if ends[f"n{i}"]}
    found = {(i, r): ends[f"a{i}"] for i, ranks in wanted.items() for r in ranks if ends[f"a{i}"] == ends[f"b{i}"]}
    #: (column, rank) -> (least, greatest, values in the range, values before it)
    open_ = {(i, r): (ends[f"a{i}"], ends[f"b{i}"], ends[f"n{i}"], 0) for i, ranks in wanted.items() for r in ranks if (i, r) not in found}
    while open_:
        ranges = sorted({(i, *open_[i, r][:2]) for i, r in open_})
        few = {k for k in ranges if next(v[2] for (i, _), v in open_.items() if (i, *v[:2]) == k) <= FEW}
        cells = _counted(data, ranges, few)
        for (i, r), (a, b, _, before) in list(open_.items()):
            k = ranges.index((i, a, b))
            at = before
            if (i, a, b) in few:
                found[i, r] = next(v for v, upto in _running(cells[k], at) if upto > r)
                del open_[i, r]
                continue
            for _, n, low, high in cells[k]:
                if at + n > r:
                    if low == high:
                        found[i, r] = low
                        del open_[i, r]
                    else:
                        open_[i, r] = (low, high, n, at)
                    break
                at += n
    return {n: [_between(ends[f"n{i}"], s, i, found) for s in shares] for i, n in enumerate(names)}


def _ranks(n: int, share: float) -> tuple[int, int]:
    at = share * (n - 1)
    return math.floor(at), math.ceil(at)


def _between(n: int, share: float, i: int, found: Mapping[tuple[int, int], float]) -> float | None:
    if not n:
        return None
    low, high = _ranks(n, share)
    return found[i, low] + (found[i, high] - found[i, low]) * (share * (n - 1) - low)


def _running(values: list[tuple], at: int):
    for _, n, low, _ in values:
        at += n
        yield low, at


def _counted(data: DataFrame, ranges: list[tuple[int, float, float]], few: set) -> list[list[tuple]]:
    """Of each range (cell, values, least, greatest) in order; the cells of a range with few values are its values themselves."""
    parts = []
    for k, (i, a, b) in enumerate(ranges):
        v = F.col(f"c{i}")
        low, high = max(a, -MOST), min(b, MOST)
        held = F.greatest(F.least(v, F.lit(MOST)), F.lit(-MOST))
        cell = v if (i, a, b) in few else F.floor((held / 2 - low / 2) / ((high / 2 - low / 2) / CELLS))
        parts.append(F.when((v >= F.lit(a)) & (v <= F.lit(b)), F.struct(F.lit(k).alias("k"), cell.cast("double").alias("cell"), v.alias("v"))))
    each = data.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    rows = each.groupBy("p.k", "p.cell").agg(F.count("*").alias("n"), F.min("p.v").alias("low"), F.max("p.v").alias("high")).collect()  # at most CELLS or FEW a range
    out: list[list[tuple]] = [[] for _ in ranges]
    for r in sorted(rows, key=lambda r: (r["k"], r["cell"])):
        out[r["k"]].append((r["cell"], r["n"], r["low"], r["high"]))
    return out
