import hashlib
import math
import random

import numpy as np
import pytest

from gridloom.llm.heaplloyd import PARTS, Block, Codebooks, vector_codes, whole_parts


def brute(rows, rounds=2):
    """Codes of rows (vec_id, vector, label), all of one length, by plain Lloyd rounds over Python numbers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // PARTS)
    parts = []
    for _, v, _ in rows:
        x = [math.floor(256 * c) for c in v] + [0] * (PARTS * width - len(v))
        parts.append([x[p * width : (p + 1) * width] for p in range(PARTS)])
    books = [[parts[i][p] for i in range(min(64, len(rows)))] for p in range(PARTS)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda c: (dist(x[p], books[p][c]), c)) for p in range(PARTS)] for x in parts]
    for _ in range(rounds):
        codes = assign()
        for p in range(PARTS):
            for c in range(len(books[p])):
                own = [x[p] for x, k in zip(parts, codes, strict=True) if k[p] == c]
                if own:
                    books[p][c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(dist(x[p], books[p][k[p]]) for p in range(PARTS)) for x, k in zip(parts, codes, strict=True)]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in k), e, by_label[r[2]], digest) for r, k, e in zip(rows, codes, errors, strict=True)]


def table(spark, rows, extra=True):
    schema = "vec_id long, embedding array<float>, label int" + (", code string, error long, x string, n long, name string, e int" if extra else "")
    return spark.createDataFrame([(*r, *(("c", 1, "x", 2, "n", 3) if extra else ())) for r in rows], schema)


def some(n, d, seed=0, spread=0.3):
    rng = random.Random(seed)
    return [(i * 3 % 1009, [float(np.float32(rng.gauss(0, spread))) for _ in range(d)], rng.choice((None, 1, 2))) for i in range(n)]


def same(got, expected):
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize(("n", "d"), [(300, 32), (64, 16), (5, 48), (1, 16), (150, 20), (90, 7)])
def test_equals_plain_rounds(spark, n, d):
    rows = some(n, d, seed=n)
    same(vector_codes(table(spark, rows)), brute(rows))


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.choice((0, 0.5, -0.5))) for _ in range(16)], 7) for i in range(200)]
    rows += [(i, [0.25] * 16, None) for i in range(60)] + [(None, [0.1] * 16, 7), (None, [-0.1] * 16, None)]
    odd = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [math.inf] * 16, 1), (904, [1e30] * 16, 1)]
    same(vector_codes(table(spark, rows + odd).repartition(5)), brute(rows))


def test_lengths_stand_by_themselves(spark):
    a, b, c = some(80, 16, 1), some(70, 32, 2), [(5, [], 1)]
    relabelled = [[(i, v, k) for i, v, _ in rows] for k, rows in ((1, a), (2, b), (3, c))]
    same(vector_codes(table(spark, sum(relabelled, []))), sum(map(brute, relabelled), []))


def test_empty(spark):
    got = vector_codes(table(spark, []))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.collect() == []


@pytest.mark.parametrize("rounds", [1, 3, 6])
def test_more_rounds(spark, rounds):
    rows = some(200, 32, seed=9)
    same(vector_codes(table(spark, rows), rounds=rounds), brute(rows, rounds))


def test_only_what_the_drift_has_caught_up_with_is_measured():
    """Well separated parts stay in their heaps; stored and read again, a block goes on as before."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 40, (64, 32))
    x = whole_parts(centres[rng.integers(0, 64, 2_000)] + rng.normal(0, 0.2, (2_000, 32)))
    books = Codebooks(whole_parts(centres + rng.normal(0, 0.05, centres.shape)).transpose(1, 0, 2).copy())
    block = Block.first(x, books)
    for _ in range(4):
        books = books.moved(block.sums[..., :-1], block.sums[..., -1])
        row = block.packed()
        block = Block.unpacked(row, 64, 2)
        seen = block.reassign(books)
        assert seen < 0.2 * x.shape[0] * PARTS
        plain = Block.first(x, books)
        assert (block.code == plain.code).all() and (block.sums == plain.sums).all()
