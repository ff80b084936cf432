import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import multiindex as m


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 6))
def test_traversal_order(seed, k1, k2):
    rng = np.random.default_rng(seed)
    index = m.MultiIndex(rng.normal(size=(k1, 2)), rng.normal(size=(k2, 2)), np.ones(k1 * k2, np.int64))
    q = rng.normal(size=4)
    a, b = index.distances(q)
    sums = (a[:, None] + b).ravel()
    got = index.traverse(q, k1 * k2)
    assert sorted(got) == list(range(k1 * k2)) and (np.diff(sums[got]) >= -1e-12).all()
    assert len(index.traverse(q, 1)) == 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "clash") for i, v in rows], "vec_id long, embedding array<float>, cell string")


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q and len(x) == len(y))
            out[q] = near[:k]
    return out


def test_exact_on_small_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(250)]
    rows += [(1000, None), (1100, [0.0] * 6), (1200, [float("nan")] + [1.0] * 5), (1300, [1.0, None, 1, 1, 1, 1]), (None, [1.0] * 6), (1400, [float("inf")] * 6), (1500, [1.0, 2.0])]
    rows += [(251, rows[0][1]), (252, rows[0][1])]  # ties at distance zero
    got: dict = {}
    for r in m.search(vectors(spark, rows), share=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    expected = {q: near for q, near in brute(rows).items() if near}
    assert set(got) == set(expected) == {0, 100, 200}
    for q, near in expected.items():
        assert [(s, v) for _, s, v in sorted(got[q])] == near and [k for k, _, _ in sorted(got[q])] == list(range(1, 11))


def test_repeated_queries(spark):
    """Every row is asked, and meets all rows but itself, also those that repeat its id."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(1, 60)]
    a, b = (rng.normal(size=6).astype(np.float32).tolist() for _ in range(2))

    def lists(queries):
        every, out = [*rows, *queries], []
        for n, (_, q) in enumerate(queries):
            others = every[: len(rows) + n] + every[len(rows) + n + 1 :]
            near = sorted((float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum())), i) for i, v in others)
            out += [(0, k + 1, i, round(s, 9)) for k, (s, i) in enumerate(near[:10])]
        return sorted(out)

    for queries in ([(0, a)] * 3, [(0, a), (0, b), (0, b)]):
        got = m.search(vectors(spark, rows + queries), share=1.0).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == lists(queries)


def test_hot_cell(spark):
    """A cell with a third of all rows is dealt over shards."""
    rng = np.random.default_rng(3)
    same = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=6).astype(np.float32).tolist()) for i in range(900)]
    got: dict = {}
    for r in m.search(vectors(spark, rows), every=50, share=1.0, shard_rows=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert len(got) == 18
    for q, mine in got.items():
        x = np.array(rows[q][1])
        near = sorted((float(np.sqrt(((x - np.array(v)) ** 2).sum())), i) for i, v in rows if i != q)[:10]
        assert [(s, v) for _, s, v in sorted(mine)] == near


def test_shards_hold_every_cell_once():
    sizes = np.array([0, 3, 100, 0, 7, 8, 1, 40])
    s = m.Shards.of(sizes, 10)
    held = np.zeros(s.count)
    for cell, n in enumerate(sizes):
        for k in range(s.parts[cell]):
            held[s.first[cell] + k] += n / s.parts[cell]
    assert held.sum() == sizes.sum() and held.max() <= 10 and s.parts[2] == 10


def lists(found):
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: [(s, v) for _, s, v in sorted(near)] for q, near in got.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 12, 20, 31, 60, 250])
def test_small_tables_are_searched_whole(spark, n):
    """At the default share: ten neighbours, or all candidates if they are fewer."""
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    expected = {q: near for q, near in brute(rows).items() if near}
    assert lists(m.search(vectors(spark, rows))) == expected and all(len(near) == min(10, n - 1) for near in expected.values())


def test_every_length_takes_part(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=(6, 6, 4, 1)[i % 4]).astype(np.float32).tolist()) for i in range(404)]
    rows += [(500, [1.0] * 9), (600, []), (800, [2.0] * 4)]
    expected = {q: near for q, near in brute(rows).items() if near}
    assert lists(m.search(vectors(spark, rows))) == expected and {0, 100, 200, 300, 400, 800} == set(expected)


def test_none(spark):
    assert m.search(vectors(spark, [])).count() == 0 and m.search(vectors(spark, [(0, None)])).count() == 0
    assert m.search(vectors(spark, [(0, [1.0, 2.0])])).count() == 0


def test_recall(spark):
    from gridloom.llm.queries import queries

    sf_dir = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got: dict = {}
    for r in queries()["op5_multiindex"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    expected = brute(rows)
    recall = sum(len(got[q] & {i for _, i in near}) for q, near in expected.items()) / sum(map(len, expected.values()))
    assert set(got) == set(expected) and recall >= 0.9
