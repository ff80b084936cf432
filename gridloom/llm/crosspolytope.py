"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs and a
fast Hadamard transform) and hashed to the nearest vertex of the cross-polytope,
its largest coordinate by magnitude with its sign. ``hashes`` such values make a
table's bucket code. Besides its own bucket a vector probes the next likely ones,
cheapest first. Vectors that meet are verified by cosine in double precision.

Equal vectors are one class before hashing, so exact copies cost nothing. A pair may
meet in many buckets; it is counted only in its first (by table, then code), which
both sides' codes tell, so link counts add up without any list of pairs. A task
returns one row per class that it linked: a partial count and a local root; roots
are joined by ``connected_components``. A bucket with many rows is cut into blocks,
and pairs of blocks are separate units of work, so no bucket is bound to one task.
All partners of all vectors are counted: nothing is capped.

Tables, hashes and probes follow the number of distinct vectors, such that buckets
stay small and a pair at the threshold is missed with probability below 0.0001. Codes
are 64-bit numbers, and a layout whose codes would not fit raises.

Defined cases: null vectors, zero vectors and vectors with null or non-finite
components link with nothing and are their own component; vectors of unlike lengths
never link; null ids count as vectors and are never a component's name unless it
has no other; repeated rows are linked copies; extra columns are not looked at; an
empty table gives an empty result. Exact copies are one class, however many they are:
their rows are dealt back by ``spread_join``, which binds no class to one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import scope, spread_join, stage
from gridloom.llm.components import connected_components

#: Rows of a bucket that are one block; a larger bucket is cut.
BLOCK = 2048
#: Rows that a task holds before it works them off.
HELD = 1 << 16
#: Largest list of split buckets that is broadcast (24 bytes a row); beyond it the list is joined by shuffling.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Layout:
    tables: int
    hashes: int
    probes: int  # with the own bucket
    seed: int = 20240501

    @classmethod
    def of(cls, n: int) -> Layout:
        """Codes grow with the number of vectors, tables and probes with the hashes in a code."""
        if n <= 1 << 13:
            return cls(6, 1, 3)
        return cls(8, 2, 3) if n <= 1 << 20 else cls(14, 3, 6)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        v = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, layout: Layout) -> np.ndarray:
    """(rows, tables, probes) bucket codes, the own bucket first, then by falling likelihood."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - d)))
    if (2 * width) ** layout.hashes >= 1 << 63:
        raise ValueError("bucket codes of so many hashes and components do not fit 64 bits")
    rng = np.random.default_rng([layout.seed, d])
    out = np.empty((n, layout.tables, layout.probes), np.int64)
    top = min(4, width)
    choices = np.array(list(itertools.product(range(top), repeat=layout.hashes)))
    for t in range(layout.tables):
        cost, code = np.zeros((n, len(choices))), np.zeros((n, len(choices)), np.int64)
        for j in range(layout.hashes):
            r = x
            for signs in rng.choice([-1.0, 1.0], size=(3, width)):
                r = hadamard(r * signs)
            size = np.abs(r)
            best = np.argsort(-size, axis=1, kind="stable")[:, :top]
            value = np.take_along_axis(size, best, 1)
            vertex = best * 2 + (np.take_along_axis(r, best, 1) > 0)
            cost += ((value[:, :1] - value) ** 2)[:, choices[:, j]]
            code = code * (2 * width) + vertex[:, choices[:, j]]
        order = np.argsort(cost, axis=1, kind="stable")[:, : layout.probes]
        got = np.take_along_axis(code, order, 1)
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = -1  # fewer vertices than probes
    return out


def _signed(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            dims = np.array([len(v) for v in lists], dtype=np.int64)
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                sig = codes(x.astype(np.float64), layout).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                        pa.array([v.tobytes() for v in sig], pa.binary()),
                        pa.array(list(sig), pa.list_(pa.int64())),
                        pa.array(np.full(len(x), d, np.int32)),
                    ],
                    names=["cls", "copies", "vec", "sig", "codes", "dim"],
                )

    return run


class _Local:
    """Union-find and link counts of what one task has met."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), np.zeros(n, np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            above = self.up[x]
            if np.array_equal(above, x):
                return x
            x = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Only pairs that are not joined yet, each of its roots once, are gone through one by one."""
        x, y = self.roots(a), self.roots(b)
        new = x != y
        if not new.any():
            return
        up = self.up
        for low, high in np.unique(np.stack((np.minimum(x[new], y[new]), np.maximum(x[new], y[new]))), axis=1).T.tolist():
            while up[low] != low:
                low = up[low]
            while up[high] != high:
                high = up[high]
            if low != high:
                up[max(low, high)] = min(low, high)
        self.up[a], self.up[b] = self.roots(a), self.roots(b)


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether (table, code) is the first place where each pair of signatures meets.

    a, b: (pairs, tables, probes). Two vectors meet at the own bucket of either if the
    other is there, too.
    """
    at_a = (a[:, :, :1] == b).any(axis=2)  # a's own bucket is among b's
    at_b = (b[:, :, :1] == a).any(axis=2)
    earlier = (at_a | at_b)[:, :table].any(axis=1)
    own_a, own_b = a[:, table, 0], b[:, table, 0]
    most = np.iinfo(np.int64).max
    least = np.minimum(np.where(at_a[:, table], own_a, most), np.where(at_b[:, table], own_b, most))
    return ~earlier & (least == code)


def _match(layout: Layout, threshold: float, dtype: str):
    def bucket(x, sig, copies, own, block, local, at, table, code, left, right):
        """Compare the own rows with all rows, between blocks left and right."""
        ids = np.arange(at, at + len(own))
        sides = [(own & (block == left), block == right)] if left == right else [(own & (block == left), block == right), (own & (block == right), block == left)]
        for i_mask, j_mask in sides:
            i, j = np.flatnonzero(i_mask), np.flatnonzero(j_mask)
            if not len(i) or not len(j):
                continue
            for start in range(0, len(i), 512):
                rows = i[start : start + 512]
                p, q = np.nonzero(x[rows] @ x[j].T >= threshold)
                p, q = rows[p], j[q]
                # two own rows are met from both sides: the first side counts
                keep = (p != q) & (~own[q] | (p < q))
                p, q = p[keep], q[keep]
                for cut in range(0, len(p), 1 << 15):
                    a, b = p[cut : cut + (1 << 15)], q[cut : cut + (1 << 15)]
                    first = first_meeting(sig[a], sig[b], table, code)
                    a, b = a[first], b[first]
                    np.add.at(local.links, ids[a], copies[b])
                    np.add.at(local.links, ids[b], copies[a])
                    local.join(ids[a], ids[b])

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        n = rows.num_rows
        col = {c: rows.column(c).to_numpy() for c in ("table", "code", "left", "right", "block", "cls", "copies", "dim")}
        own = rows.column("own").to_numpy(zero_copy_only=False).astype(bool)
        vec, sig = rows.column("vec").to_pylist(), rows.column("sig").to_pylist()
        unit = np.flatnonzero(np.any([np.concatenate(([True], col[c][1:] != col[c][:-1])) for c in ("table", "code", "dim", "left", "right")], axis=0))
        local = _Local(n)
        for at, to in zip(unit, np.append(unit[1:], n), strict=True):
            if to - at < 2 or not own[at:to].any():
                continue
            x = np.frombuffer(b"".join(vec[at:to]), dtype).reshape(to - at, -1).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            s = np.frombuffer(b"".join(sig[at:to]), np.int64).reshape(to - at, layout.tables, layout.probes)
            bucket(x, s, col["copies"][at:to], own[at:to], col["block"][at:to], local, at, col["table"][at], col["code"][at], col["left"][at], col["right"][at])
        cls = col["cls"]
        met = np.flatnonzero(local.links > 0)
        if not len(met):
            return None
        roots = local.roots(met)
        return pa.RecordBatch.from_arrays([pa.array(cls[met]), pa.array(local.links[met]), pa.array(cls[roots])], names=["cls", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        keys = ("table", "code", "dim", "left", "right")
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                size += b.num_rows
                if size < HELD:
                    continue
            if not held:
                continue
            rows = pa.Table.from_batches(held)
            cut = rows.num_rows
            if b is not None:  # the last unit may go on in the next batch
                other = np.any([rows.column(k).to_numpy() != rows.column(k)[-1].as_py() for k in keys], axis=0)
                cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            held = rows.slice(cut).combine_chunks().to_batches() if cut < rows.num_rows else []
            size = rows.num_rows - cut
            if cut and (out := work(rows.slice(0, cut))) is not None:
                yield out

    return run


def usable(vector: str):
    """Vectors that take part: known, finite, not zero."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One staged row per distinct usable vector: (cls, first, copies, embedding)."""
    own = vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    return stage(
        own.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("cls"), "first", "copies", "embedding"),
        "near-classes",
    )


def class_links(distinct: DataFrame, threshold: float, layout: Layout) -> DataFrame:
    """Partial rows (cls, links, root) of all verified meetings."""
    dtype = "<f4" if "float" in distinct.schema["embedding"].dataType.simpleString() else "<f8"
    signed = stage(
        distinct.select("cls", "copies", "embedding").mapInArrow(_signed(layout), "cls long, copies long, vec binary, sig binary, codes array<long>, dim int"),
        "near-signed",
    )
    place = F.posexplode("codes").alias("pos", "code")
    table, own = F.floor(F.col("pos") / layout.probes).cast("int"), F.col("pos") % layout.probes == 0
    sizes = signed.select("dim", place).select("dim", table.alias("table"), "code").groupBy("dim", "table", "code").count()
    large = stage(sizes.where(F.col("count") > BLOCK).select("dim", "table", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "near-large")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    rows = signed.select("cls", "copies", "vec", "sig", "dim", place).where("code >= 0").select("cls", "copies", "vec", "sig", "dim", table.alias("table"), "code", own.alias("own"))
    split = rows.join(large, ["dim", "table", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = split.select(
        "table", "code", "dim", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "own", "cls", "copies", "vec", "sig"
    )
    keys = ["table", "code", "dim", "left", "right"]
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_match(layout, threshold, dtype), "cls long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, layout: Layout | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    with scope(vectors.sparkSession):
        known, total = _classes_known(vectors, id_col, vector_col, threshold, layout)
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"), usable(vector_col).alias("takes_part"))
    linked = spread_join(rows.where("takes_part").select("vec_id", "embedding"), known, "embedding", "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("takes_part")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _classes_known(vectors: DataFrame, id_col: str, vector_col: str, threshold: float, layout: Layout | None) -> tuple[DataFrame, int]:
    """(embedding, copies, n_links, component_id) of each class, and the number of rows that take part."""
    distinct = classes(vectors, id_col, vector_col)
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    layout = layout or Layout.of(size["n"])
    met = stage(class_links(distinct, threshold, layout), "near-met")
    named = connected_components(met.select(F.col("root").alias("src"), F.col("cls").alias("dst"))).withColumnRenamed("node", "cls")
    firsts = stage(named.join(distinct.select("cls", "first"), "cls"), "near-members")
    least = stage(firsts.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("members")), "near-least")
    component = spread_join(firsts.select("cls", "component"), least, "component", "members", firsts.count()).select("cls", "least")
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    known = distinct.join(links, "cls", "left").join(component, "cls", "left")
    known = known.select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    return stage(known, "near-known", keep=True), size["rows"]
