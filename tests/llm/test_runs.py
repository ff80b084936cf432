import hashlib
import random
import zlib

import pytest

from gridloom.llm import queries
from gridloom.llm.runs import kept_words, periodic_runs, planted, run_digests, runs_of


def brute(words, least=12):
    """All runs by comparing every word with the one q places on."""
    n, whole, out = len(words), [], []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and not any(q % p == 0 and s <= i and e >= j + q for s, e, p in whole):
                whole.append((i, j + q, q))
                if j - i + q >= least:
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def listed(found):
    return [[tuple(map(int, r)) for r in runs] for runs in found]


def test_random_texts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.randint(0, 60)
            words = [rng.randrange(rng.randint(1, 4)) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 8)
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least = rng.choice((2, 4, 12))
        assert listed(runs_of(texts, least)) == [brute(t, least) for t in texts]


@pytest.mark.parametrize(
    ("words", "runs"),
    [
        (["a"] * 100_000, [(0, 100_000, 1)]),
        (["a", "b"] * 50_000, [(0, 100_000, 2)]),
        (list(range(40_000)), []),
        ([*range(900)] * 40, [(0, 36_000, 900)]),
    ],
)
def test_long_texts(words, runs):
    assert listed(runs_of([words, ["x"]])) == [runs, []]


def test_fibonacci_words_hold_many_runs():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    assert listed(runs_of([list(b)])) == [brute(list(b))] and len(brute(list(b))) > 20


def test_many_positions_take_the_wider_keys(monkeypatch):
    from gridloom.llm import runs

    texts = [[*range(7)] * 5, list("abababababababx"), ["z"] * 13]
    packed = listed(runs_of(texts))
    monkeypatch.setattr(runs, "PACKED", 3)
    assert listed(runs_of(texts)) == packed == [brute(t) for t in texts]


def test_words_after_the_first_period_go():
    words = list("xabcabcabcabcaby")
    (found,) = runs_of([words])
    assert "".join(w for w, k in zip(words, kept_words(len(words), found), strict=True) if k) == "xabcy"


def of_query(doc_id, text):
    """What the contract asks for one row, step by step."""
    words = (text or "").replace("\x0b", " ").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    spelled = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("ab", "c", "d e", "ß")) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, " \t\n"), (None, "a " * 30), (7, "b\x0bb\x0cb\rb\nb\tb b b b b b b"), (7, "b " * 20), (153, "x" * 100_000), (154, "y z " * 4_000)]
    docs = docs_of(rows)
    got = run_digests(periodic_runs(docs.select("doc_id", planted(docs["doc_id"], docs["text"]).alias("text"))))
    expected = [of_query(*r) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t) and any(r[1] for r in expected)


def test_empty_table_and_columns(spark, docs_of):
    found = periodic_runs(docs_of([]))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and run_digests(found).collect() == []
    (row,) = periodic_runs(docs_of([(1, "a b " * 10)])).collect()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (20, [(0, 20, 2)], "a b")


def test_registered():
    assert "op11_runs" in queries.queries() and "op11_runs" in queries.oracle_sql()
