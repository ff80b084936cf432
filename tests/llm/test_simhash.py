import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abAB \t\n\x0b é z", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefg", k=500))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_agrees(spark):
    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("one two three", 42)


@pytest.mark.parametrize(("seed", "budget", "large"), [(0, 3, 1 << 18), (1, 3, 4), (2, 2, 1), (3, 4, 1), (4, 1, 1), (5, 0, 1)])
def test_links_against_all_pairs(spark, seed, budget, large):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(fps)[:5]:  # tight groups of unlike fingerprints
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    named = {r["node"]: r["component"] for r in connected_components(simhash.link_fingerprints(df, budget, large)).collect()}
    expected = components(fps, lambda a, b: (a ^ b).bit_count() <= budget)
    groups: dict = {}
    for f, c in zip(fps, expected, strict=True):
        groups.setdefault(c, []).append(int(np.uint64(f).astype(np.int64)))
    for members in groups.values():
        assert len({named.get(m, m) for m in members}) == 1
        assert named.get(members[0], members[0]) == min(members)
    assert set(named) == {m for g in groups.values() if len(g) > 1 for m in g}


def test_small_frontier(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 3)
    rng = np.random.default_rng(0)
    rest = np.unique(rng.integers(0, 1 << 12, 200, dtype=np.uint64))
    group = np.zeros(len(rest), np.int64)
    order, root = simhash.trie_components(group, rest, 12, 2)
    expected = components([int(r) for r in rest[order]], lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(set(zip(root, expected, strict=True))) == len(set(root)) == len(set(expected))


def test_defined_cases(docs_of):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b c d"), (3, "A B c\td"), (3, "A B c\td"), (None, "a b c d"), (9, "x y"), (None, "lonely words here now")]
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.simhash_groups(docs_of(rows)).collect()]
    assert len(got) == len(rows)
    by = {}
    for d, _, c in got:
        by.setdefault(d, set()).add(c)
    assert by[5] == by[6] == by[7] == {5} and by[8] == by[3] == {3} and by[9] == {9} and by[None] == {3, None}
    assert simhash.simhash_groups(docs_of([])).count() == 0


def test_long_chains(spark):
    edges = spark.range(300).selectExpr("id as src", "id + 1 as dst").union(spark.createDataFrame([(1000, 1001), (1001, 1001), (5000, 1000)], "src long, dst long"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[5000] == got[1001] == 1000
    assert connected_components(edges.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from gridloom.llm.queries import queries

    rows = queries()["op9_simhash"](spark, sf_dir).collect()
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    group = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(d, f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, group, strict=True)}
