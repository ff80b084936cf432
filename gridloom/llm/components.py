"""Connected components by repeated contraction, without collecting anything.

Each round points every vertex at its smallest neighbour (pointers only ever
decrease, so they form a forest), doubles the pointers until all lead to roots,
renames the edges' ends to their roots, and drops the loops. Stars, which is what the
near-duplicate operators emit, vanish in the first round; a chain of n vertices takes
doublings in the logarithm of n.
The vertex with the smallest id never moves, so the final name of a component
is its smallest vertex. The few keys that hold a large share of all rows, such as the
hub of a star, are joined by broadcast (``spread_join``), so no key is bound to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import scope, spread_join, stage


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges (src, dst) -> (node, component) for every vertex that has an edge to another.

    Loops, repeated and reversed edges and rows with nulls do no harm; no edges
    give an empty result.
    """
    with scope(edges.sparkSession):
        return stage(_contracted(edges, max_rounds), "cc-named", keep=True)


def _contracted(edges: DataFrame, max_rounds: int) -> DataFrame:
    e = stage(
        edges.where("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct(),
        "cc-edges",
    )
    names: DataFrame | None = None
    for _ in range(max_rounds):
        n = e.count()
        if not n:
            break
        both = e.union(e.select("dst", "src"))
        degrees = stage(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"), F.count("*").alias("degree")), "cc-up")
        up = _to_roots(degrees.select("node", F.least("node", "m").alias("parent")))
        known = degrees.select("node", "degree").join(up, "node")
        by_src = known.select(F.col("node").alias("src"), F.col("parent").alias("a"), "degree")
        by_dst = known.select(F.col("node").alias("dst"), F.col("parent").alias("b"), "degree")
        moved = stage(spread_join(e, by_src, "src", "degree", 2 * n).select("a", "dst"), "cc-half")
        e = stage(
            spread_join(moved, by_dst, "dst", "degree", 2 * n)
            .where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .distinct(),
            "cc-edges",
        )
        if names is None:
            names = up.select("node", F.col("parent").alias("component"))
        else:
            names = stage(_renamed(names, up, "component"), "cc-names")
    else:
        raise RuntimeError("components did not converge")
    if names is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return names


def _above(rows: DataFrame, up: DataFrame, name: str) -> DataFrame:
    """(name, above, n): where each value of rows' column ``name`` points, and its number of rows."""
    held = rows.groupBy(name).agg(F.count("*").alias("n"))
    return held.join(up.select(F.col("node").alias(name), F.col("parent").alias("above")), name, "left").select(name, F.coalesce("above", name).alias("above"), "n")


def _renamed(rows: DataFrame, up: DataFrame, name: str) -> DataFrame:
    """Rows (node, name) whose ``name`` has moved to where ``up`` points."""
    known = stage(_above(rows, up, name), "cc-above")
    return spread_join(rows, known, name, "n", rows.count()).select("node", F.col("above").alias(name))


def _to_roots(up: DataFrame, most: int = 64) -> DataFrame:
    """Pointers (node, parent) doubled until every parent points at itself."""
    for _ in range(most):
        known = stage(_above(up, up, "parent"), "cc-above")
        if known.where("above <> parent").isEmpty():
            return up
        up = stage(spread_join(up, known, "parent", "n", up.count()).select("node", F.col("above").alias("parent")), "cc-up")
    raise RuntimeError("pointers did not converge")
