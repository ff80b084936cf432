import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import transducer as t


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


CASES = ["", " ", "   ", "Hello  world", " lead", "trail  ", "a\nb\tc", "ﬁ Ａ ½ é é", "日本\U0001f600", "▁x a▁b", " x", "<s> </s> <unk> <0x0A>", "a\x00b", "x" * 3000, "aaaa" * 50 + " " * 40 + "b"]


@pytest.mark.parametrize("text", CASES)
def test_cases(library, text):
    m = t.machine(None)
    assert m.encode(text).tolist() == library.encode(text)
    assert m.decode(m.encode(text)) == library.decode(library.encode(text)) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet="thewindor ▁.\n", max_size=60))
def test_any_text(library, text):
    m = t.machine(None)
    assert m.encode(text).tolist() == library.encode(text)
    assert m.decode(m.encode(text)) == text.replace("▁", " ")


def test_real_texts(spark, sf_dir, library):
    m = t.machine(None)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect():
        assert m.encode(r["text"]).tolist() == library.encode(r["text"])


def test_memory_is_bounded(library, monkeypatch):
    import public_tokenizers

    m = t.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(t, "REMEMBERED", 5)
    monkeypatch.setattr(t, "VERDICTS", 5)
    text = "some quite different words in one single long sentence of prose"
    assert m.encode(text).tolist() == library.encode(text) and len(m.units) <= 5 and len(m.follows) <= 5


def toy(weights, merging=False):
    """A machine over pieces with weights; bytes and all else are the public model's."""
    import ahocorasick

    m, other = t.machine(None), object.__new__(t.Transducer)
    names = list(weights)
    trie = ahocorasick.Automaton()
    for i, p in enumerate(names):
        trie.add_word(p, (i, len(p), t.APART, weights[p]))
    trie.make_automaton()
    other.__dict__ |= m.__dict__ | {"merging": merging, "trie": trie, "names": names, "ids": {p: i for i, p in enumerate(names)}, "weights": list(weights.values()), "letters": {p for p in names if len(p) == 1}, "follows": {}, "byte_weight": 50.0}
    return other


def test_least_cost_without_merges():
    m = toy({"a": 1.0, "b": 1.0, "ab": 1.5, "abc": 9.0, "c": 1.0})
    assert m.shortest_path("abc") == [2, 4] and m.shortest_path("a\x00") == [0, t.machine(None).bytes[0]]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 40).map(float), min_size=1, max_size=12), st.text("abcd", min_size=1, max_size=9))
def test_shortest_path_against_all_paths(weights, text):
    """The cost of the path that comes out is the least over all segmentations."""
    m = toy(weights)
    least = {0: 0.0}
    for j in range(1, len(text) + 1):
        ways = [least[i] + weights[text[i:j]] for i in range(j) if i in least and text[i:j] in weights]
        if text[j - 1] not in weights and j - 1 in least:
            ways.append(least[j - 1] + 50.0)
        if ways:
            least[j] = min(ways)
    if len(text) not in least:
        with pytest.raises(ValueError):
            m.shortest_path(text)
        return
    byte = set(t.machine(None).bytes) - set(range(len(weights)))
    got = m.shortest_path(text)
    assert sum(50.0 if i in byte else m.weights[i] for i in got) == pytest.approx(least[len(text)])


@settings(max_examples=150, deadline=None)
@given(st.text("thewindor ▁", min_size=1, max_size=12))
def test_the_filter_leaves_one_path(text):
    """Of all sequences of pieces whose neighbours agree, one is left, and the merges give it."""
    m = t.machine(None)
    text = text.replace(" ", t.BLANK)

    def paths(at, last):
        if at == len(text):
            yield []
        for j in range(at + 1, len(text) + 1):
            b = m.ids.get(text[at:j])
            if b is not None and m._merge(text[at:j]) == [text[at:j]] and (last < 0 or m.may_follow(last, b)):
                for rest in paths(j, b):
                    yield [b, *rest]

    assert list(paths(0, -1)) == [m.shortest_path(text)] and [m.names[i] for i in m.shortest_path(text)] == m._merge(text)


@settings(max_examples=150, deadline=None)
@given(st.text(" ab\t", max_size=20), st.booleans())
def test_normaliser(text, prefix):
    import re

    plain, squeezed = (t.Normaliser(prefix, s).compose(text, t.BEGIN)[0] for s in (False, True))
    first = t.BLANK if prefix else ""
    assert plain == (first + text.replace(" ", t.BLANK) if text else "")
    short = re.sub(" +", " ", text).strip(" ")
    assert squeezed == (first + short.replace(" ", t.BLANK) if short else "")


def test_defined_cases(docs_of, library):
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "word " * 20_000)]
    got = sorted((r["doc_id"] or 0, r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in t.encode_digests(docs_of(rows)).collect())
    expected = []
    for i, x in rows:
        ids = library.encode(x or "")
        expected.append((i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert got == sorted(expected)
    assert t.encode_digests(docs_of([])).count() == 0
    back = {r["doc_id"]: r["text"] for r in t.decode(t.encode(docs_of([(7, "Hi é\n there"), (8, None)]))).collect()}
    assert back == {7: "Hi é\n there", 8: ""}


def test_query(spark, sf_dir, library):
    from gridloom.llm.queries import queries

    rows = {r["doc_id"]: r for r in queries()["op8_sentencepiece"](spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(d["text"])
        row = rows[d["doc_id"]]
        assert row["n_pieces"] == len(ids) and row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and row["round_trip"]
