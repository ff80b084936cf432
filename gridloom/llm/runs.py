"""Periodic runs of words, by Crochemore's partition refinement.

A run is a maximal stretch of consecutive words with smallest period q that is at least 2q
(and ``least``) words long. Positions are kept in classes of equal factors of length l, for l = 1, 2, ...
A class of factors of length l splits by the classes of their successors, and only the smaller
parts of what split last time have to be looked at (all but one largest child of each parent),
so every position moves at most log n times. Each class keeps its positions as a linked list in text
order: a position whose next class member lies exactly l places on starts a square of period l, and such
links with a primitive root are always neighbours. A link with gap g is born and dies at known lengths, so it is looked
at once, when it dies; consecutive squares of one period are one run.

The texts of a batch are refined together, as if they were one: words of unlike texts are in unlike classes, and a
word that occurs nowhere else ends each text. Rows of a batch are dealt by length, so long texts share
their many levels. Refinement ends as soon as no link is longer than the length that was reached.

Defined cases: null text has no words and no runs, its collapsed text is empty; null and repeated ids keep
their rows; texts of any length are read whole; words are what stands between ASCII white space; other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ship

#: Bytes of text that are refined together; a longer text is refined by itself.
GROUP_BYTES = 1 << 22
#: Up to this many positions three numbers fit one sort key.
PACKED = 21
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _sorted(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of numbers from -1 (b only) to n - 1, in order."""
    if n < 1 << PACKED:
        key = np.sort((a << 2 * PACKED) | ((b + 1) << PACKED) | c)
        low = (1 << PACKED) - 1
        return key >> 2 * PACKED, ((key >> PACKED) & low) - 1, key & low
    by = np.lexsort((c, b, a))
    return a[by], b[by], c[by]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places where a new group of equal neighbours begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Partition:
    """Classes of positions with equal factors of length ``level``."""

    def __init__(self, names: np.ndarray, texts: np.ndarray):
        """names: the class of each position, 0, 1, ..; texts: the text that each class belongs to."""
        n = self.n = len(names)
        self.level = 1
        self.cls = names.astype(np.int64)
        count = np.bincount(self.cls, minlength=len(texts))
        self.classes = len(texts)
        self.size = np.zeros(n + 1, np.int64)
        self.size[: len(texts)] = count
        #: class c holds order[first[c] : first[c] + size[c]], in no particular order
        self.first = np.zeros(n + 1, np.int64)
        self.first[: len(texts)] = np.cumsum(count) - count
        self.order = np.argsort(self.cls, kind="stable")
        self.where = np.empty(n, np.int64)
        self.where[self.order] = np.arange(n)
        self.next = np.full(n, -1, np.int64)
        self.prev = np.full(n, -1, np.int64)
        self.born = np.ones(n, np.int64)
        same = self.cls[self.order[1:]] == self.cls[self.order[:-1]]
        left, right = self.order[:-1][same], self.order[1:][same]
        self.next[left], self.prev[right] = right, left
        self.moved = np.zeros(n, bool)
        by = np.lexsort((count, texts))
        largest = by[np.append(np.flatnonzero(texts[by][1:] != texts[by][:-1]), len(by) - 1)]
        small = np.ones(len(texts), bool)
        small[largest] = False
        #: positions of all classes but one of those that each class was split into last
        self.small = np.flatnonzero(small[self.cls])
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _died(self, at: np.ndarray) -> None:
        """The links that begin at these positions are no more: those alive at the level of their gap were squares."""
        gap = self.next[at] - at
        square = (self.next[at] >= 0) & (self.born[at] <= gap) & (gap < self.level)
        if square.any():
            self.squares.append((at[square], gap[square]))

    def _chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, part, position) of all that leaves its class, in order; of each class one largest part stays."""
        at = self.small - 1
        at = at[at >= 0]
        at = at[self.size[self.cls[at]] > 1]
        if not len(at):
            return at, at, at
        old, part, at = _sorted(self.cls[at], self.cls[at + 1], at, self.n)
        head = _heads(old, part)
        count = np.diff(np.append(head, len(at)))
        lead = _heads(old[head])  # of each class the first of its parts
        owner = old[head][lead]
        rest = self.size[owner] - np.add.reduceat(count, lead)
        most = np.maximum.reduceat(count, lead)
        turned = np.flatnonzero(most > rest)  # here the largest part stays, and what was not touched leaves
        if not len(turned):
            return old, part, at
        of = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(head))))
        tops = np.flatnonzero(count == most[of])
        stays = np.zeros(len(head), bool)
        top = tops[_heads(of[tops])]
        stays[top[turned]] = True
        leave = ~np.repeat(stays, count)
        wide = turned[rest[turned] > 0]
        if not len(wide):
            return old[leave], part[leave], at[leave]
        self.moved[at] = True
        every = self.order[_ranges(self.first[owner[wide]], self.size[owner[wide]])]
        others = every[~self.moved[every]]
        self.moved[at] = False
        return _sorted(np.append(old[leave], self.cls[others]), np.append(part[leave], np.full(len(others), -1)), np.append(at[leave], others), self.n)

    def refine(self) -> bool:
        """On to factors of the next length; False if all classes stay as they are."""
        old, part, at = self._chosen()
        if not len(at):
            self.small = at
            return False
        self.level += 1
        self.moved[at] = True
        self._unlink(old, at)
        head = _heads(old, part)
        count = np.diff(np.append(head, len(at)))
        self._link(at, head)
        self._relocate(old, at)
        names = self.classes + np.arange(len(head))
        self.classes += len(head)
        self.first[names] = self.where[at[head]]
        self.size[names] = count
        self.cls[at] = np.repeat(names, count)
        self.moved[at] = False
        self.small = np.sort(at)
        return True

    def _unlink(self, old: np.ndarray, at: np.ndarray) -> None:
        """Bridge the gaps that leaving positions make in their classes' lists; neighbours leave as one chain."""
        before, after = self.prev[at], self.next[at]
        begins = (before < 0) | ~self.moved[before]
        ends = (after < 0) | ~self.moved[after]
        nothing = np.zeros(int(begins.sum()), np.int64)
        _, _, first = _sorted(old[begins], nothing, at[begins], self.n)
        _, _, last = _sorted(old[ends], nothing, at[ends], self.n)
        left, right = self.prev[first], self.next[last]
        held = left[left >= 0]
        self._died(held)
        self.next[held] = right[left >= 0]
        self.born[held] = self.level
        self.prev[right[right >= 0]] = left[right >= 0]

    def _link(self, at: np.ndarray, head: np.ndarray) -> None:
        """Lists of the new classes; links that stay as they were keep their age."""
        after = np.append(at[1:], -1)
        after[head[1:] - 1] = -1
        changed = self.next[at] != after
        self._died(at[changed])
        self.born[at[changed]] = self.level
        self.next[at] = after
        before = np.insert(at[:-1], 0, -1)
        before[head] = -1
        self.prev[at] = before

    def _relocate(self, old: np.ndarray, at: np.ndarray) -> None:
        """Leaving positions go to the end of their class's stretch, part by part, and the stretch is cut there."""
        lead = _heads(old)
        owner, count = old[lead], np.diff(np.append(lead, len(at)))
        self.size[owner] -= count
        begin = self.first[owner] + self.size[owner]
        slots = _ranges(begin, count)
        held = self.order[slots]
        stay = held[~self.moved[held]]
        free = self.where[at]
        free = free[free < np.repeat(begin, count)]
        self.order[free] = stay
        self.where[stay] = free
        self.order[slots] = at
        self.where[at] = slots

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of every square with a primitive root."""
        look = 16
        while self.refine():
            if self.level >= look:  # links no longer than the level are decided
                if not (self.next - np.arange(self.n) > self.level).any():
                    break
                look = self.level + max(16, self.level // 4)
        self.level += 1
        self._died(np.flatnonzero(self.next >= 0))
        if not self.squares:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.squares, strict=True))


def runs_of(texts: Sequence[Sequence], least: int = 12) -> list[np.ndarray]:
    """Of each text (a list of words) its runs: rows (start, length, period), by start and period."""
    names, owners, starts, base, n = [], [], [], 0, 0
    for k, words in enumerate(texts):
        known: dict = {}
        names.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        names.append(np.array([base + len(known)]))  # ends the text
        owners.append(np.full(len(known) + 1, k))
        base += len(known) + 1
        starts.append(n)
        n += len(words) + 1
    if not names:
        return []
    at, period = Partition(np.concatenate(names), np.concatenate(owners)).all_squares()
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    rows = np.column_stack((at[head], count - 1 + 2 * period[head], period[head]))
    rows = rows[rows[:, 1] >= least]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    offsets = np.array(starts)
    owner = np.searchsorted(offsets, rows[:, 0], "right") - 1
    rows[:, 0] -= offsets[owner]
    return np.split(rows, np.searchsorted(owner, np.arange(1, len(starts))))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            by = np.argsort(sizes, kind="stable")
            group = np.cumsum(sizes[by]) // GROUP_BYTES
            for rows in np.split(by, np.flatnonzero(np.diff(group)) + 1):
                own = b.take(pa.array(rows))
                yield _digested(own.column(0), [(t or b"").split() for t in own.column(1).to_pylist()], least)

    return run


def _digested(ids: pa.Array, texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    found = runs_of(texts, least)
    collapsed = []
    for words, runs in zip(texts, found, strict=True):
        if len(runs):
            words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
        collapsed.append(b" ".join(words))
    cells = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    offsets = np.cumsum([0, *map(len, found)])
    runs = pa.StructArray.from_arrays([pa.array(cells[:, k]) for k in range(3)], fields=list(RUN))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs of ``least`` or more words, and the text without what they repeat."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(_found(least), SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of about every tenth id with its words made periodic from some place on."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    some = (F.pmod(h, F.lit(10)) == 0) & text.rlike("[^\\x20\\x09-\\x0D]")
    return F.when(some, F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of ``periodic_runs``' rows."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("most", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("most.start")).alias("start"),
        F.col("most.length").alias("length"),
        (-F.col("most.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("most.length") / -F.col("most.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
