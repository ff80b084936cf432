"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding makes one skeleton of the ways to write a letter: case, Cyrillic and Greek
look-alikes, compatibility forms (full-width, mathematical), digits and signs that
stand for letters, and letters that are drawn alike (l, i, 1, ! and |). Characters
without width go, letters that one sign or blank each keeps apart (i.d.i.o.t) are joined,
and repeated letters are written once. Every folded word stands between blanks, so
entries can ask for a word's beginning or for a whole word.

The lexicon is learned, as weights of words and of words' first letters, from a
bounded sample of labelled documents (``sample``, a documented parameter: that many
labelled rows with the smallest id hashes; of rows that repeat an id the one with the
smallest text). The sample's folded texts are staged once. Entries of a seed list and
exception phrases are added; an exception phrase covers the entries inside it. All entries are
one automaton; a document's matches, weighted and divided by the logarithm of its
length, and their number feed a logistic function fitted on the sample.

Defined cases: null text is an empty text, whose features are zero; a text of any
length is folded and matched whole, in time that grows with its length; of entries that
begin at one place the heaviest counts, and of equally heavy ones any, as they add the
same; null ids are kept and never learned from; repeated rows are scored alike; extra
columns are not looked at; without learning rows scores follow the seed list; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import crc_fold, pieces, scope, stage, training_labels

#: Seed entries: whole words that count whatever the labels say.
SEED = ("idiot", "moron", "scum", "loser", "worthless", "pathetic")
SEED_WEIGHT = 3.0
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("scum line", "pond scum", "loser tree", "sore loser board", "trash can", "trash bin", "clown fish", "worthless check")

#: Look-alikes of Latin letters, and signs that stand for them.
LOOKALIKES = {
    "a": "аαɑ4àáâãäå", "b": "вβ8", "c": "сϲç", "d": "ԁ", "e": "еεɛ3èéêë", "g": "ɡ9", "h": "һн", "i": "іιı1lìíîï", "j": "ј",
    "k": "кκ", "m": "м", "n": "ոñ", "o": "оοσ0òóôõö", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5ß", "t": "тτ7", "u": "υսùúûü", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уүýÿ", "z": "2",
}
#: Signs that stand for letters only before another word character, as they end words, too.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e", "¢": "c"}
PREFIXES = (3, 4, 5, 6)
#: Smallest number of toxic sample documents that an entry needs, and how many times likelier in toxic ones it must be.
LEAST_DOCS, LEAST_LIFT = 4, 8.0
#: Characters without width that may stand inside a word.
WIDTHLESS = (0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF)
#: Automata built in this worker, by what they match.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _fold_table() -> dict[int, str]:
    table = {ord(c): letter for letter, looks in LOOKALIKES.items() for c in looks}
    table |= {ord(c.upper()): letter for letter, looks in LOOKALIKES.items() for c in looks if len(c.upper()) == 1 and c.upper() != c}
    table |= {i: chr(i + 32) for i in range(65, 91) if chr(i) != "L"}
    table[ord("L")] = "i"
    # full-width forms
    for i in range(0xFF01, 0xFF5F):
        plain = i - 0xFEE0
        table[i] = table.get(plain, chr(plain))
    return table | dict.fromkeys(WIDTHLESS)


FOLD = _fold_table()
_GAPS = re.compile(r"[^\w]+|_")
_SIGNS = re.compile(r"(?<=\w)[@$!|+€¢](?=\w)|(?<!\S)[@$](?=\w)")
#: Four letters or more, each kept from the next by the same sign or blank.
_APART = re.compile(r"(?<![^\W_])[^\W_]([\W_])[^\W_](?:\1[^\W_]){2,}(?![^\W_])")
_REPEATED = re.compile(r"(\w)\1+")


def fold(text: str | None) -> str:
    """Skeleton of a whole text: folded words between single blanks, with a blank at both ends."""
    if not text:
        return " "
    skeleton = text.translate(FOLD)
    if not text.isascii():
        skeleton = unicodedata.normalize("NFKC", skeleton).translate(FOLD)
    skeleton = _SIGNS.sub(lambda m: SIGNS[m[0]], skeleton.lower())
    skeleton = _APART.sub(lambda m: _GAPS.sub("", m[0]), skeleton)
    return " " + _REPEATED.sub(r"\1", _GAPS.sub(" ", skeleton)).strip() + " "


def terms(folded: str) -> set[str]:
    """What a document may teach: its words, and words' beginnings, in lexicon form."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


@dataclass
class Lexicon:
    """Weighted entries, exception phrases and the logistic function over their matches."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 2.0, 1.0]))

    def __post_init__(self):
        spelled = repr((sorted(self.weights.items()), self.exceptions))
        self.key = hashlib.sha256(spelled.encode()).hexdigest()

    def automaton(self) -> ahocorasick.Automaton:
        """Built once in a worker, which keeps the last one."""
        if self.key not in _BUILT:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                a.add_word(fold(phrase), (len(fold(phrase)), None))
            a.make_automaton()
            _BUILT.clear()
            _BUILT[self.key] = a
        return _BUILT[self.key]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(weight by length, weight, distinct entries), each damped."""
        return self.matched(fold(text))

    def matched(self, folded: str) -> tuple[float, float, float]:
        """The same of a text that is folded already."""
        if not self.weights:
            return 0.0, 0.0, 0.0
        hits, covered = [], []
        for end, (size, w) in self.automaton().iter(folded):
            (covered if w is None else hits).append((end - size + 1, end, w))
        if covered:  # a hit is covered if the phrases that begin no later reach its end
            covered.sort()
            starts, reach = [a for a, _, _ in covered], []
            for _, end, _ in covered:
                reach.append(max(end, reach[-1]) if reach else end)
            hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or reach[k - 1] < h[1]]
        if not hits:
            return 0.0, 0.0, 0.0
        best: dict[int, float] = {}  # entries that begin at the same place are one match
        for start, _, w in hits:
            if start not in best or abs(w) > abs(best[start]):
                best[start] = w
        total = max(0.0, sum(best.values()))
        words = max(1, folded.count(" ") - 1)
        strong = sum(w > 1 for w in best.values())
        return np.log1p(total / (1 + np.log1p(words / 50))), np.log1p(total), np.log1p(strong)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.coef[0] + x @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies: (term, toxic documents, documents)."""
    toxic: Counter[str] = Counter()
    every: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        names = list(every)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([every[t] for t in names], pa.int64())], names=["term", "bad", "all"])

    for b in pieces(batches):
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen = terms(text)
            every.update(seen)
            if y:
                toxic.update(seen)
        if len(every) > 500_000:
            yield flush()
            toxic.clear()
            every.clear()
    yield flush()


def learn(sample: DataFrame) -> Lexicon:
    """Lexicon of a bounded, staged sample (folded, label)."""
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    weights = {}
    if bad and good:
        counted = sample.select("folded", "label").mapInArrow(_count, "term string, bad long, all long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
        lift = ((F.col("bad") + 0.1) / (bad + 1)) / ((F.col("all") - F.col("bad") + 0.5) / (good + 1))
        weight = F.ln(lift)
        telling = counted.where((F.col("bad") >= LEAST_DOCS) & (lift >= LEAST_LIFT))
        # bounded by the sample: each stands in several of its toxic documents
        weights = {r["term"]: float(r["w"]) for r in telling.select("term", weight.alias("w")).collect()}
    for word in SEED:
        weights.setdefault(fold(word), SEED_WEIGHT)
    lexicon = Lexicon(weights)
    if bad and good:
        lexicon.coef = _logistic(lexicon, sample)
    return lexicon


def _features(lexicon: Lexicon, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [lexicon.matched(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([v[i] for v in x], pa.float64()) for i in range(3))], names=[*columns])

    return run


def _logistic(lexicon: Lexicon, sample: DataFrame, rounds: int = 30, ridge: float = 0.5) -> np.ndarray:
    """Newton's method on the sample's features: three numbers a document, at most ``sample`` documents."""
    got = sample.select(F.col("label").cast("long").alias("y"), "folded").mapInArrow(_features(lexicon, ("y", "a", "b", "c")), "y long, a double, b double, c double").toPandas()
    x = np.column_stack((np.ones(len(got)), got[["a", "b", "c"]].to_numpy()))
    y = got["y"].to_numpy(float)
    w = np.array([-3.0, 0.0, 0.0, 0.0])
    penalty = ridge * np.diag([0.0, 1, 1, 1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ penalty @ w / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(4)
        step, before, size = np.linalg.solve(hessian, x.T @ (p - y) + penalty @ w), loss(w), 1.0
        while loss(w - size * step) > before and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _scored(lexicon: Lexicon, text: int):
    """Rows with a score appended; ``text`` is the text column's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = np.array([lexicon.features(t) for t in b.column(text).to_pylist()], dtype=np.float64).reshape(b.num_rows, 3)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lexicon.score(x), pa.float64())], names=[*b.schema.names, "score"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with a last column ``score``; a column of that name among docs is replaced."""
    own = docs.drop("score")
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    return own.mapInArrow(_scored(lexicon, own.columns.index(text_col)), schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """Staged (folded, label) of at most ``sample`` labelled documents; only their ids are sent to the executors."""
    spark = docs.sparkSession
    chosen = training_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    small = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], "doc_id long, label int")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(small), "doc_id")
    once = known.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return stage(once.select("text", "label").mapInArrow(_folded, "folded string, label int"), "toxicity-sample")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["folded", "label"])


def lexicon_of(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Lexicon:
    """Lexicon learned from docs (doc_id, text) and their labels."""
    with scope(docs.sparkSession):
        return learn(labelled_sample(docs, labels, "toxic", sample))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scored(own, lexicon_of(own, labels, sample)).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
