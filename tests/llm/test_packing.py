import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import packing


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'st \n\t.  é漢1", max_size=40))
def test_ids(reference, text):
    assert packing.encoder(None).ids(text).tolist() == reference(text)


def test_ids_of_real_texts(spark, sf_dir, reference):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect():
        assert packing.encoder(None).ids(r["text"]).tolist() == reference(r["text"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "'s", "é漢", "1", "word"]), max_size=12).map("".join))
def test_ids_of_added_tokens(reference, text):
    assert packing.encoder(None).ids(text).tolist() == reference(text)


def test_packed_added_token(docs_of, reference):
    texts = [(0, "hi <|endoftext|> there"), (1, "<|endoftext|>"), (2, "a  <|endoftext|><|endoftext|>b"), (3, "plain")]
    assert reference(texts[0][1]) == [5303, 220, 50256, 612]
    check(packing.pack(docs_of(texts)).collect(), {i: [*reference(t), 1] for i, t in texts})


def check(pieces, ids, window=2048):
    """Every id in one piece, sequences gapless, no padding but at powers of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, expected in ids.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            part = np.array(expected[at : at + p["length"]], "<u4")
            assert p["start"] == at and p["doc_tokens"] == len(expected) and p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(expected)
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and len(s) >= 1
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_defined_cases(docs_of, reference):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(["tree", "river", "stone", "Über", "x1"], k=rng.randint(0, 900)))) for i in range(80)]
    texts += [(900, None), (901, ""), (902, "long " * 9000), (903, " lead  and  trail \n ")]
    check(packing.pack(docs_of(texts)).collect(), {i: [*reference(t), 1] for i, t in texts})
    again = packing.pack(docs_of([(None, "a b"), (None, "a b"), (4, "c"), (4, "c")])).collect()
    assert sum(p["length"] for p in again) == 2 * len(reference("a b")) + 2 + 2 * 2
    assert packing.pack(docs_of([])).count() == 0


def test_sharded(docs_of, reference):
    texts = [(i, f"word{i % 7} " * 50) for i in range(60)]
    got = packing.pack(docs_of(texts), shard_tokens=1500).collect()
    assert len({p["sequence_id"] >> 32 for p in got}) > 3
    check(got, {i: [*reference(t), 1] for i, t in texts})


def test_bm25_scores():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint16) for _ in range(20)]
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((20 - df + 0.5) / (df + 0.5))
    mean = np.mean([len(d) for d in docs])
    index = packing.ShardIndex(docs, idf, mean, query_terms=1000)
    for q in range(20):
        expected = [sum(idf[t] * (d == t).sum() * (packing.K1 + 1) / ((d == t).sum() + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in np.unique(docs[q])) for d in docs]
        assert np.allclose(index.scores(q), expected, rtol=1e-5)


def test_windows_take_the_nearest_unused():
    docs = [np.full(6, 1, np.uint16), np.full(6, 2, np.uint16), np.full(6, 1, np.uint16), np.full(6, 2, np.uint16)]
    idf = np.ones(1 << 16)
    pieces = list(packing.fill_windows(docs, packing.ShardIndex(docs, idf, 6.0, 8), 12))
    assert [[d for d, *_ in pieces if _[2] == s] for s in (0, 1)] == [[0, 2], [1, 3]]


def test_seeds_ask_with_all_their_terms(docs_of):
    """Document 1 shares the 40 heaviest terms of document 0, document 2 its 200 others, which weigh more together."""
    encoding = packing.encoder(None).encoding
    words = [w for w in map(encoding.decode, ([i] for i in range(300, 2000))) if w[0] == " " and w[1:].isascii() and w[1:].islower() and len(encoding.encode(w)) == 1][:240]
    heavy, others = "".join(words[:40]), "".join(words[40:])
    got = packing.pack(docs_of([(0, heavy * 3 + others), (1, heavy), (2, others)]), window=421).collect()
    assert {p["doc_id"] for p in got if p["sequence_id"] == 0} == {0, 2}


def test_query(spark, sf_dir, reference):
    from gridloom.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(queries()["op6_packing"](spark, sf_dir).collect(), {r["doc_id"]: [*reference(r["text"]), 1] for r in docs})


def test_very_long_pieces(reference):
    for text in ("a" * 20_000, " " * 20_000, "é" * 9_000, "ab " * 9_000, "\n" * 9_000):
        assert packing.encoder(None).ids(text).tolist() == reference(text)


def test_shards_bound_tokens_and_documents(docs_of, reference):
    """Short texts, one text held by most rows and repeated rows without ids: shards stay near their size, nothing is lost."""
    rows = [(i, f"tale {i} of the {['river', 'stone', 'forest'][i % 3]}") for i in range(120)] + [(500 + i, "the same copied words again and again") for i in range(200)] + [(None, "")] * 100
    got = packing.pack(docs_of(rows), shard_tokens=1000).collect()
    assert sum(p["length"] for p in got) == sum(len(reference(t)) + 1 for _, t in rows)
    shards: dict = {}
    for p in got:
        shards.setdefault(p["sequence_id"] >> 32, []).append(p)
    assert len(shards) > 8
    assert max(sum(p["length"] + packing.DOCUMENT for p in s if p["start"] == 0) for s in shards.values()) <= 4 * 1000
    check(got, {i: [*reference(t), 1] for i, t in rows if i is not None})


def test_texts_that_share_heavy_terms_meet():
    rng = np.random.default_rng(1)
    idf = np.full(1 << 16, 2.0)
    base = rng.integers(300, 5000, 200)
    near = base.copy()
    near[-5:] = rng.integers(300, 5000, 5)
    heavy = np.concatenate((base, np.repeat(base[:3], (9, 6, 3))))
    assert packing.route(heavy, idf, 200.0) == packing.route(np.concatenate((near, np.repeat(base[:3], (9, 6, 3)))), idf, 200.0)
    assert packing.route(heavy, idf, 200.0) >> 32 == base[0]


def test_whole_windows_stay_where_they_are(docs_of, reference):
    rows = [(1, "one two three four " * 3000), (2, "x y " * 1000), (3, "short")]
    got = packing.pack(docs_of(rows)).collect()
    check(got, {i: [*reference(t), 1] for i, t in rows})
    alone = [p for p in got if p["sequence_id"] >= packing.FULL_WINDOWS]
    assert alone and all(p["length"] == 2048 and p["offset"] == 0 and p["start"] % 2048 == 0 for p in alone)
    assert len({p["sequence_id"] for p in alone}) == len(alone)


@pytest.mark.parametrize("blanks", [" " * 3_000_000, "\n" * 3_000_000, " \n" * 1_500_000, "\t \r\n" * 600_000, "\u00a0" * 1_100_000, " " * 100_001])
@pytest.mark.parametrize("around", ["{}", "a{}b", "it's {}<|endoftext|> end"])
def test_very_long_blanks(reference, blanks, around):
    text = around.format(blanks)
    assert packing.encoder(None).ids(text).tolist() == reference(text)


def test_very_long_blanks_are_packed(docs_of, reference):
    text = "one" + " " * 1_200_000 + "two"
    pieces = packing.pack(docs_of([(1, text), (2, "short")])).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 1) == len(reference(text)) + 1
