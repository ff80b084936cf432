"""SimHash near-duplicates, linked by a binary-trie self-join.

A document's fingerprint has bit b set if over half of its word shingles' 64-bit
hashes have it set. Two fingerprints link when they differ in at most ``budget``
bits; components of links are the near-duplicate groups.

The join. The 64 bits are cut into ``budget + 2`` blocks; fingerprints within the
budget agree in at least two of them, so every such pair meets in one of the
C(blocks, 2) tables keyed by a pair of blocks. Inside a key the remaining bits form
a binary trie. Node pairs are walked together from the root pair downwards, a pair
of unlike children costs one bit, and a pair that exceeds the budget is pruned.
Distinct fingerprints only take part, so copies cost nothing; pairs of subtrees
already known to be one component are pruned too, so a tight group of many unlike
fingerprints is not expanded into all its pairs. A task emits a star per local
component, never its pairs, and the stars are joined by ``connected_components``.

A key with more than ``large`` fingerprints is cut the same way once more: what is left
of its bits makes ``budget + 2`` chunks, at least two of which agree in a linked pair,
so each pair of chunks keys a part of its own. Nothing is lost, and with three bits no
part can hold more than 2^24 fingerprints, however many copies a group has.

Defined cases: null text is an empty text; texts without words have fingerprint
zero and link like any other; a text with fewer words than a shingle is one shingle;
null ids are ignored as a component's smallest id unless the whole component has
none (then the component is null); repeated rows give repeated result rows; other
columns, whatever their names, are not looked at; an empty table gives an empty
result. A text of any length is hashed whole, CHUNK shingles at a time. A bit set in
exactly half of the hashes is 0, and of equal ids the component's name is that id. A
fingerprint that a large share of all rows holds (wordless texts, copies) is dealt
back to its rows by ``spread_join``, which binds no key to one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pieces, scope, spread_join, stage
from gridloom.llm.components import connected_components

#: Shingle hashes handled at once, so that one huge document needs no huge array.
CHUNK = 1 << 16
#: Distinct fingerprint rows walked at once, and node pairs expanded at once.
LEAVES, FRONTIER = 1 << 20, 1 << 18
#: Fingerprints of a key that are walked as one; a larger key is cut by further chunks.
LARGE = 1 << 18
#: Longest list of large keys that is broadcast (12 bytes a row); beyond it the list is joined by shuffling.
BROADCAST_ROWS = 50_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    # bytes.lower() touches A-Z only, bytes.split() cuts at space and 09-0D only
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    counts = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        starts = np.concatenate(([0], ends))[at:to].tolist()
        stops = (ends[at + k - 1 : to + k - 1] - 1).tolist()
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprints(shingle), "doc_id long, fp long"
    )


def block_layout(budget: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of the budget + 2 blocks that so many bits are cut into."""
    n = budget + 2
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def block_pairs(budget: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(budget + 2), 2))


def without(layout: list[tuple[int, int]], pair: tuple[int, int]) -> list[tuple[int, int]]:
    """The blocks that are left when a pair's have become a key."""
    return [block for i, block in enumerate(layout) if i not in pair]


def rest_bits(budget: int) -> int:
    """The most bits that any pair of blocks leaves."""
    return max(sum(w for _, w in without(block_layout(budget), pair)) for pair in block_pairs(budget))


def _gather(x: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The blocks' bits side by side, the first ones highest."""
    out = np.zeros(len(x), np.uint64)
    for shift, width in blocks:
        out = (out << np.uint64(width)) | ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Union-find over the leaves of one walk, with labels that can be read by range."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.refresh()
        self.fresh = 0

    def refresh(self) -> None:
        """Every leaf points at its root; runs of equal roots become visible to ``uniform``."""
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                break
            self.up = above
        change = np.concatenate(([0], (self.up[1:] != self.up[:-1]).astype(np.int64), [0]))
        self.changes = np.cumsum(change)
        self.fresh = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                self.fresh += 1

    def same(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Node pairs all of whose leaves were one component at the last refresh."""
        c = self.changes
        return (c[ahi - 1] == c[alo]) & (c[bhi - 1] == c[blo]) & (self.up[alo] == self.up[blo])


def trie_components(group: np.ndarray, rest: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Local components of rows that share a group and differ in at most budget bits of rest.

    Returns (order, root): root[i] is the position in ``order`` of the component's
    first row. Rows of different groups never meet. (group, rest) pairs are distinct.
    """
    order = np.lexsort((rest, group))
    g, r = group[order], rest[order]
    n = len(r)
    forest = _Forest(n)
    near = (g[1:] == g[:-1]) & (_popcount(r[1:] ^ r[:-1]) <= budget)
    forest.up[1:][near] = np.flatnonzero(near)
    forest.refresh()
    ones = {}

    def counts(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (r >> np.uint64(bits - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        return ones[depth]

    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    stops = np.append(starts[1:], n)
    some = stops - starts > 1
    lo, hi = starts[some], stops[some]
    todo = [(0, lo[i : i + FRONTIER], hi[i : i + FRONTIER], lo[i : i + FRONTIER], hi[i : i + FRONTIER], np.zeros(len(lo[i : i + FRONTIER]), np.int8)) for i in range(0, len(lo), FRONTIER)]
    while todo:
        depth, alo, ahi, blo, bhi, err = todo.pop()
        if forest.fresh * 8 > n:
            forest.refresh()
        keep = ~forest.same(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():  # two leaves: what is left of both paths is compared at once
            a, b = alo[leaf], blo[leaf]
            hit = _popcount(r[a] ^ r[b]) <= budget
            forest.link(a[hit], b[hit])
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or depth == bits:
            continue
        c = counts(depth)
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = (alo == blo) & (ahi == bhi)
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), tuple(x[~own] for x in (am, ahi, blo, bm, err + 1))]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi == bhi) & (ahi - alo == 1))
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        for i in range(0, len(alo), FRONTIER):
            todo.append((depth + 1, *(x[i : i + FRONTIER] for x in (alo, ahi, blo, bhi, err))))
    forest.refresh()
    return order, forest.up


def _stars(budget: int):
    layout, pairs = block_layout(budget), block_pairs(budget)

    def remaining(table: int, fp: np.ndarray) -> tuple[np.ndarray, int]:
        """What a table's keys leave of the fingerprints, and how many bits that are."""
        part, t = divmod(table, len(pairs))
        blocks = without(layout, pairs[t])
        rest, bits = _gather(fp, blocks), sum(w for _, w in blocks)
        if part:  # a part of a large key
            blocks = without(block_layout(budget, rest_bits(budget)), pairs[part - 1])
            rest, bits = _gather(rest, blocks), sum(w for _, w in blocks)
        return rest, bits

    def walk(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        rest, most = np.zeros(len(fp), np.uint64), 0
        for t in np.unique(table):
            mine = table == t
            rest[mine], bits = remaining(int(t), fp[mine])
            most = max(most, bits)
        group = np.cumsum(np.concatenate(([0], (table[1:] != table[:-1]) | (key[1:] != key[:-1]))))
        order, root = trie_components(group, rest, most, budget)
        leaf = np.flatnonzero(root != np.arange(len(root)))
        out = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[order[root[leaf]]]), pa.array(out[order[leaf]])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(np.stack([b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()]))
                if sum(x.shape[1] for x in held) < LEAVES:
                    continue
            if not held:
                continue
            x = np.concatenate(held, axis=1)
            cut = x.shape[1]
            if b is not None:  # the last key may go on in the next batch
                last = (x[0] == x[0, -1]) & (x[1] == x[1, -1])
                cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            held = [x[:, cut:]] if cut < x.shape[1] else []
            if cut:
                yield walk(x[0, :cut], x[1, :cut], np.ascontiguousarray(x[2, :cut]).view(np.uint64))

    return run


def _keys(bits: Column, layout: list[tuple[int, int]], budget: int) -> list[Column]:
    """The key of every pair of blocks."""

    def block(i: int) -> Column:
        shift, width = layout[i]
        return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))

    return [F.shiftleft(block(a), layout[b][1]).bitwiseOR(block(b)) for a, b in block_pairs(budget)]


def _parts_of_large(hot: DataFrame, budget: int) -> DataFrame:
    """The large keys' rows (table, key, fp), dealt by pairs of chunks of the bits that are left."""
    layout, pairs = block_layout(budget), block_pairs(budget)
    chunks = block_layout(budget, rest_bits(budget))
    shift = max(chunks[a][1] + chunks[b][1] for a, b in pairs)

    def rest(pair: tuple[int, int]) -> Column:
        out = F.lit(0).cast("long")
        for at, width in without(layout, pair):
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    known = F.lit(None).cast("long")
    for t, pair in enumerate(pairs):
        known = F.when(F.col("table") == t, rest(pair)).otherwise(known)
    keys = F.array(*_keys(F.col("rest"), chunks, budget))
    dealt = hot.withColumn("rest", known).select("table", "key", "fp", F.posexplode(keys).alias("part", "chunk"))
    table = F.col("table") + (F.col("part") + 1) * len(pairs)
    return dealt.select(table.alias("table"), F.shiftleft("key", shift).bitwiseOR(F.col("chunk")).alias("key"), "fp")


def link_fingerprints(distinct: DataFrame, budget: int = 3, large: int = LARGE) -> DataFrame:
    """Stars (src, dst) whose components are those of all pairs of ``fp`` within the budget."""
    keys = [F.struct(F.lit(t).alias("table"), key.alias("key")) for t, key in enumerate(_keys(F.col("fp"), block_layout(budget), budget))]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.table", "k.key", "fp")
    if budget > 1:  # below that a pair of blocks is most of the fingerprint, and no key is large
        most = stage(dealt.groupBy("table", "key").count().where(F.col("count") > large).select("table", "key"), "simhash-large")
        found = most.count()
        if found:
            listed = F.broadcast(most) if found <= BROADCAST_ROWS else most
            cut = _parts_of_large(dealt.join(listed, ["table", "key"], "left_semi"), budget)
            dealt = dealt.join(listed, ["table", "key"], "left_anti").unionByName(cut)
    return dealt.repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(_stars(budget), "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the group's smallest id."""
    rows = stage(fingerprint_table(docs, id_col, text_col, shingle), "simhash-rows")
    with scope(docs.sparkSession):
        distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-distinct")
        linked = connected_components(link_fingerprints(distinct, budget)).withColumnRenamed("node", "fp")
        members = stage(linked.join(distinct, "fp"), "simhash-members")
        least = stage(members.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("members")), "simhash-least")
        named = spread_join(members.select("fp", "component"), least, "component", "members", members.count()).select("fp", "least")
        groups = distinct.join(named, "fp", "left").select("fp", "copies", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
        groups = stage(groups, "simhash-groups", keep=True)
    return spread_join(rows, groups, "fp", "copies", rows.count()).select("doc_id", "fp", "component_id")
