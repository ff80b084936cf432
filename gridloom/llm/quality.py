"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each document gives a short vector of statistics of its whole text (letter cases,
symbols, word lengths, repetition, punctuation). Random Fourier features of the
standardised vector approximate a Gaussian kernel. Ridge weights solve the normal
equations, which partitions sum up (a fixed-size matrix each) and a tree of tasks adds.
The sums are kept by ``FOLDS`` folds of the learning rows: a fold's rows are scored by the
weights of the others, these scores are counted in a fixed number of bins, and pooling
adjacent violators over the bins gives the calibration, which thus sees no row that its
weights have seen. The final weights are those of all learning rows. The labelled
rows, a few numbers each, are joined and staged once; every pass reads them.

Defined cases: null text is an empty text; empty texts have all statistics zero and
are scored like any other; a text of any length is measured whole; null ids are kept
and never learned from; repeated rows and all texts of equal statistics are scored
alike, so scores tie; extra columns are not looked at; without any learning rows every
score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import crc_fold, pieces, scope, stage, training_labels

#: Names of the document statistics, in order.
STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "punctuation", "symbol", "non_ascii", "mean_word",
    "word_spread", "distinct_words", "top_word", "top_line", "lines_repeated", "stops", "exclaims", "caps_words", "odd_ends", "bars", "squeeze", "vowels", "line_words",
)
BINS = 512
#: Folds of the learning rows, each calibrated by the weights of the others.
FOLDS = 3
#: Bytes of each text that the compressibility statistic reads at a time; all of the text is read.
SQUEEZED = 1 << 20


def _classes() -> np.ndarray:
    """Byte -> class: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 plain punctuation, 7 symbol, 8 non-ASCII, 9 '!', 10 '|', 11 '.', with vowels told apart later."""
    c = np.zeros(256, np.uint8)
    for chars, k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 3), (" \t", 4), ("\n\r", 5), (",;:'\"()-?", 6), ("#$%&*+/<=>@[\\]^_`{}~", 7), ("!", 9), ("|", 10), (".", 11)):
        c[list(chars.encode())] = k
    c[128:] = 8
    return c


CLASSES = _classes()
VOWELS = np.zeros(256, bool)
VOWELS[list(b"aeiouAEIOU")] = True


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(CLASSES, weights=by_byte, minlength=12) / n
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if not m:
        return [np.log1p(n), 0.0, *share[[1, 2, 3, 4, 5, 6, 7, 8]], *[0.0] * (len(STATISTICS) - 10)]
    sizes = np.fromiter(map(len, words), np.int64, m)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    distinct_lines = set(lines)
    odd = sum(c for w, c in seen.items() if w[-1] in b"#$%&*@!|~^")
    caps = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    packed = sum(len(zlib.compress(raw[i : i + SQUEEZED], 1)) for i in range(0, n, SQUEEZED))
    letters = (share[1] + share[2]) * n
    return [
        np.log1p(n), np.log1p(m), share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], sizes.mean(),
        sizes.std(), len(seen) / m**0.75, max(seen.values()) / m, max(map(len, lines)) / n, 1 - len(distinct_lines) / len(lines),
        share[11] * n / m, share[9] * n / m, caps / m, odd / m, share[10] * n / m, packed / n, by_byte[VOWELS].sum() / max(letters, 1), np.log1p(m / len(lines)),
    ]


def _measure(text: int):
    """Rows with their statistics appended; ``text`` is the text column's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [np.asarray(statistics(t), np.float64) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, pa.list_(pa.float64()))], names=[*b.schema.names, "x"])

    return run


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a last column ``x``, the statistics; a column of that name among docs is replaced."""
    own = docs.drop("x")
    schema = T.StructType([*own.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    return own.mapInArrow(_measure(own.columns.index(text_col)), schema)


@dataclass
class FourierRidge:
    """Everything that scoring needs; its size does not depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: tuple[float, float]
    steps: np.ndarray  # calibrated score of each bin

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.hstack((cosines, np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        lo, hi = self.edges
        return np.clip((raw - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.steps[self.bins(self.raw(x))]


def pool_adjacent_violators(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing rates for consecutive bins; empty bins take the rate of those before them."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total > 0):
        blocks.append([positive[i], total[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += t
    out = np.full(len(total), 0.5)
    for k, (p, t, start) in enumerate(blocks):
        stop = blocks[k + 1][2] if k + 1 < len(blocks) else len(total)
        out[0 if k == 0 else int(start) : int(stop)] = p / t
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column(0).to_pylist():
            v = np.frombuffer(raw)
            total = v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum of the vectors that ``part`` makes of each batch (x matrix, labels, folds); one vector reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                total += part(x, b.column(1).to_numpy().astype(np.float64), b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    # staged rows are cut by size, so vectors are few beside the rows; a task of the second level adds about as many as there are such tasks
    parts = rows.rdd.getNumPartitions()
    summed = rows.select("x", "label", "fold").mapInArrow(run, "v binary")
    if parts > 4:
        summed = summed.repartition(max(1, round(parts**0.5))).mapInArrow(_added, "v binary")
    got = summed.coalesce(1).mapInArrow(_added, "v binary").collect()
    return np.frombuffer(got[0]["v"]) if got else np.zeros(size)


def learning_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged (x, label, fold) of the labelled rows."""
    known = rows.select("doc_id", "x").join(training_labels(labels, "quality"), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return stage(known.select("x", F.col("label").cast("int").alias("label"), fold.alias("fold")), "quality-learning")


def fit(rows: DataFrame, width: int = 256, bandwidth: float = 3.0, ridge: float = 1.0, seed: int = 7) -> FourierRidge | None:
    """Fit on staged (x, label, fold) rows, all of them; None if there are none."""
    d = len(STATISTICS)
    moments = _summed(rows, lambda x, y, fold: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))), 1 + 2 * d)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    model = FourierRidge(mean, scale, rng.normal(size=(d, width)) / bandwidth, rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), (0.0, 1.0), np.full(BINS, 0.5))
    k = width + 1

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        f, out = model.features(x), []
        for j in range(FOLDS):
            mine = f[fold == j]
            out += [(mine.T @ mine).ravel(), mine.T @ y[fold == j]]
        return np.concatenate(out)

    sums = _summed(rows, normal, FOLDS * (k * k + k)).reshape(FOLDS, -1)
    penalty = ridge * np.eye(k)
    penalty[-1, -1] = 1e-6

    def solved(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[: k * k].reshape(k, k) + penalty, total[k * k :])

    model.weights = solved(sums.sum(0))
    model.edges = (-0.5, 1.5)
    others = np.stack([solved(sums.sum(0) - sums[j]) for j in range(FOLDS)])

    def counted(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        at = model.bins((model.features(x) * others[fold]).sum(1))
        return np.concatenate((np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS)))

    counts = _summed(rows, counted, 2 * BINS)
    model.steps = pool_adjacent_violators(counts[:BINS], counts[BINS:])
    return model


def _score(model: FourierRidge | None, x: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            s = np.full(n, 0.5) if model is None or not n else model.score(b.column(x).flatten().to_numpy().reshape(n, -1))
            kept = [c for k, c in enumerate(b.columns) if k != x]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64())], names=[*(c for k, c in enumerate(b.schema.names) if k != x), "score"])

    return run


def scored(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged rows (doc_id, .., x) with ``score`` in the place of ``x``, learned from their labels."""
    with scope(rows.sparkSession):
        model = fit(learning_rows(rows, labels))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "x"), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(model, rows.columns.index("x")), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(measured(own).select("doc_id", "x"), "quality-statistics")
    return scored(rows, labels).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
