"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file are three machines over the tropical semiring (min, +):

* the normaliser, a transducer of a few states whose arcs copy characters, write blanks
  for spaces, put the dummy prefix in front and, if the model asks, squeeze spaces;
* the pieces, a transducer with one state and an arc for each piece (its characters, its
  id, its negative score), and arcs from each character that is no piece to the ids of its
  bytes. The arcs are kept in a trie automaton that lists those which end at a position;
* the neighbour filter, an acceptor of id sequences. For a model of the BPE kind its
  states are the last ids, and an arc leads from a to b if merging the joined characters
  of both, best pair first, gives back just these two. A sequence all of whose neighbours
  agree is the one that the merges produce, so the paths it leaves are BPE encodings. A
  unigram model's filter has one state and accepts everything.

An input is composed with the three lazily, state by state: a state is a position with
a filter state. ``shortest_path`` relaxes all their arcs in topological order, adding
weights along a path and taking the least, for both kinds of model alike.

No piece has a blank after another character, so a text falls into units at its
blanks, whose paths are independent; a worker remembers units (bounded).

Defined cases: null text is an empty text and has no ids; null ids are kept; repeated
rows are encoded alike; a text of any length is encoded whole, unit by unit; of paths
that cost the same the one with the longer last piece wins; extra columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pieces

BLANK = "▁"
#: Units and neighbour verdicts remembered by a worker; beyond that it starts anew.
REMEMBERED, VERDICTS = 1_000_000, 1_000_000
#: Longer units are not remembered.
LONGEST_UNIT = 64
#: What a character that is no piece costs beyond the dearest piece.
BYTE_PENALTY = 10.0
#: The filter state that no piece gives: the start, after bytes, and the only one of a filter that accepts everything.
APART = -1
_UNITS = re.compile(f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+")
_RUNS = re.compile("[ ]+|[^ ]+")
_MACHINES: dict[str, Transducer] = {}

#: States of the normaliser: nothing written yet, after a character, after spaces that are held back.
BEGIN, INSIDE, HELD = range(3)


@dataclass(frozen=True)
class Arc:
    """An arc of the normaliser: what it writes (None: the character read) and where it leads."""

    output: str | None
    next: int


class Normaliser:
    """A transducer over two classes of input, spaces and all other characters."""

    def __init__(self, prefix: bool, squeeze: bool):
        first = BLANK if prefix else ""
        if squeeze:
            #: (state, is a space) -> arc; spaces are written only before what follows them
            self.arcs = {(BEGIN, True): Arc("", BEGIN), (INSIDE, True): Arc("", HELD), (HELD, True): Arc("", HELD), (BEGIN, False): Arc(None, INSIDE), (INSIDE, False): Arc(None, INSIDE), (HELD, False): Arc(None, INSIDE)}
            self.before = {BEGIN: first, INSIDE: "", HELD: BLANK}
        else:
            self.arcs = {(s, space): Arc(BLANK if space else None, INSIDE) for s in (BEGIN, INSIDE) for space in (True, False)}
            self.before = {BEGIN: first, INSIDE: ""}

    def compose(self, text: str, state: int) -> tuple[str, int]:
        """What the machine writes for a text from a state on, and the state it ends in.

        A run of one class is read at once where its arc is a loop.
        """
        out = []
        for run in _RUNS.findall(text):
            space, at = run[0] == " ", 0
            while at < len(run):
                arc = self.arcs[state, space]
                n = len(run) - at if arc.next == state else 1
                if arc.output != "":
                    out.append(self.before[state])
                    out.append(run[at : at + n] if arc.output is None else arc.output * n)
                state, at = arc.next, at + n
        return "".join(out), state


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return out, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, i = raw[i : i + size], i + size
        else:
            size = 8 if wire == 1 else 4
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


class Transducer:
    """The compiled machine of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in spec if k == 2), b"")))
        normaliser = dict(_fields(next((v for k, v in spec if k == 3), b"")))
        if normaliser.get(2):
            raise ValueError("only models with the identity normaliser are supported")
        self.merging = trainer.get(3, 1) == 2
        self.prefix = bool(normaliser.get(3, 1))
        self.normaliser = Normaliser(self.prefix, bool(normaliser.get(4, 1)))
        n = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.ids = {self.names[i]: i for i in range(n) if not special(i)}
        self.weights = [-model.get_score(i) for i in range(n)]
        self.bytes = [0] * 256
        self.output = [p.replace(BLANK, " ").encode() for p in self.names]
        for i in range(n):
            if model.is_byte(i):
                value = int(self.names[i][3:-1], 16)
                self.bytes[value] = i
                self.output[i] = bytes([value])
            elif special(i):
                self.output[i] = b""
        self.begin_only = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.follows: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.byte_weight = max((self.weights[i] for i in self.ids.values()), default=0.0) + BYTE_PENALTY
        self.kind, self.letter = ("<u2", "H") if n <= 1 << 16 else ("<u4", "I")
        #: Pieces that their own characters merge to; others are on no path.
        self.trie = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if not self.merging or len(p) == 1 or self._merge(p) == [p]:
                self.trie.add_word(p, (i, len(p), i * n if self.merging else APART, self.weights[i]))
        self.trie.make_automaton()

    def _merge(self, text: str) -> list[str]:
        """Characters merged best pair first, leftmost among equals."""
        parts, ids, weights = list(text), self.ids, self.weights
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or weights[i] < best):
                    best, at = weights[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """The neighbour filter's arc: whether the merges leave a and b apart."""
        key = a * len(self.names) + b
        known = self.follows.get(key)
        if known is None:
            x, y = self.names[a], self.names[b]
            known = self._merge(x + y) == [x, y]
            if len(self.follows) >= VERDICTS:
                self.follows.clear()
            self.follows[key] = known
        return known

    def shortest_path(self, unit: str) -> list[int]:
        """Ids of the cheapest path over one normalised unit.

        ``reached[j]`` is what is live at position j: (filter state times the number of
        pieces, cost, what it came from, piece, position). Arcs into a position are relaxed after
        all arcs into those before it. Either kind of filter leaves one live state at a position:
        one that accepts everything has only one, and BPE's admits one path to any prefix (its
        encoding), so the position is closed once that is found.
        """
        size, follows, merging = len(unit), self.follows, self.merging
        reached: list[tuple | None] = [None] * (size + 1)
        reached[0] = (APART, 0.0, None, APART, 0)
        bare = not self.letters.issuperset(unit)  # some character is no piece
        done = 0
        for end, (b, n, state, weight) in self.trie.iter(unit):
            if bare:
                while done < end:
                    done += 1
                    self._relax_bytes(unit, reached, done)
            target = reached[end + 1]
            source = reached[end + 1 - n]
            if source is None or (merging and target is not None):
                continue
            if source[0] >= 0:  # the filter's arc by b
                ok = follows.get(source[0] + b)
                if not (self.may_follow(source[3], b) if ok is None else ok):
                    continue
            cost = source[1] + weight
            if target is None or cost < target[1]:
                reached[end + 1] = (state, cost, source, b, end + 1)
        while bare and done < size:
            done += 1
            self._relax_bytes(unit, reached, done)
        return self._path(unit, reached[size])

    def _relax_bytes(self, unit: str, reached: list[tuple | None], j: int) -> None:
        """The arc of a character that is no piece."""
        if unit[j - 1] not in self.letters and reached[j - 1] is not None:
            cost = reached[j - 1][1] + self.byte_weight
            if reached[j] is None or cost < reached[j][1]:
                reached[j] = (APART, cost, reached[j - 1], APART, j)

    def _path(self, unit: str, at: tuple | None) -> list[int]:
        if at is None:
            raise ValueError(f"no path for {unit!r}")
        out: list[int] = []
        while at[2] is not None:
            if at[3] >= 0:
                out.append(at[3])
            else:
                out.extend(self.bytes[x] for x in reversed(unit[at[4] - 1].encode("utf-8", "replace")))
            at = at[2]
        out.reverse()
        return out

    def _unit(self, raw: str, state: int) -> bytes:
        path = self.shortest_path(self.normaliser.compose(raw, state)[0])
        return struct.pack(f"<{len(path)}{self.letter}", *path)

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a whole text."""
        if not text:
            return np.array([], dtype=self.kind)
        if not self.begin_only:
            return np.frombuffer(self._unit(text, BEGIN), dtype=self.kind)
        units = _UNITS.findall(text)
        known = self.units
        out = [b""]
        for u in units[1:]:
            ids = known.get(u)
            if ids is None:
                ids = self._unit(u, INSIDE)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(u) <= LONGEST_UNIT:
                    known[u] = ids
            out.append(ids)
        out[0] = self._unit(units[0], BEGIN)
        return np.frombuffer(b"".join(out), dtype=self.kind)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        raw = b"".join(map(self.output.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


def machine(path: str | None) -> Transducer:
    """The worker's machine for a model file; by default the public 32k model with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in pieces(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.encode(t).astype(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in pieces(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded rows."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        low, high = min(m.bytes), max(m.bytes)
        for b in pieces(batches, 128):
            rows = []
            for text in b.column(1).to_pylist():
                ids = m.encode(text)
                x = ids.astype("<u4")
                back = m.decode(ids)
                rows.append((len(ids), int(((x >= low) & (x <= high)).sum()), zlib.crc32(x.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "").replace(BLANK, " ")))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_bytes, ids_crc32, decoded_sha256, round_trip): every whole text encoded and decoded."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_digests(model), "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
