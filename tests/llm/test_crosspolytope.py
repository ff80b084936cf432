import numpy as np
import pytest

from gridloom.llm import crosspolytope as c


def brute(rows, threshold=0.95):
    ok = {k: np.array(v, np.float32).astype(float) for k, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = list(ok)
    for a in keys:
        for b in keys:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((i, links[k], min(ids) if ids else None))
    return out


def run(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, cls string, codes string")
    return [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in c.near_duplicates(df, **kwargs).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def groups(seed, n=60, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        centre = rng.normal(size=d)
        for _ in range(1 if g % 3 else int(rng.integers(2, 12))):
            rows.append((len(rows), (centre + rng.normal(size=d) * 0.12).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("layout", [None, c.Layout(8, 2, 3), c.Layout(14, 3, 6)])
def test_against_all_pairs(spark, layout):
    rows = groups(1)
    got = run(spark, rows, layout=layout)
    assert sorted(r[:3] for r in got) == sorted(brute(rows)) and all(k == (i == m) for i, _, m, k in got)


@pytest.mark.parametrize("width", [64, 384, 768, 1024, 1536])
@pytest.mark.parametrize("layout", [c.Layout(6, 1, 3), c.Layout(8, 2, 3), c.Layout(14, 3, 6)])
def test_pairs_near_the_threshold_meet(width, layout):
    """Pairs at cosine 0.95 to 0.97 meet, in a bucket that exists, and their first meeting is counted once."""
    rng = np.random.default_rng(width)
    n = 120 if width > 64 else 1000
    a = rng.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.normal(size=(n, width))
    u -= (u * a).sum(1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.97, (n, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * u
    p, q = c.codes(a, layout), c.codes(b, layout)
    assert (p >= 0).all() and (q >= 0).all() and p.dtype == np.int64
    counted = np.zeros(n, int)
    for t in range(layout.tables):
        for i in range(n):
            for code in {p[i, t, 0], q[i, t, 0]}:
                if code in p[i, t] and code in q[i, t]:
                    counted[i] += c.first_meeting(p[i : i + 1], q[i : i + 1], t, code)[0]
    assert counted.max() <= 1 and (counted == 0).sum() <= (1 if n > 500 else 0)


@pytest.mark.parametrize("layout", [c.Layout(8, 2, 3), c.Layout(14, 3, 6)])
def test_wide_vectors_against_all_pairs(spark, layout):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(25):
        centre = rng.normal(size=768)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((len(rows), (centre + rng.normal(size=768) * 0.15).astype(np.float32).tolist()))
    assert sorted(r[:3] for r in run(spark, rows, layout=layout)) == sorted(brute(rows))


def test_copies_of_a_third_of_all_rows(spark):
    """A class that holds far more than its share is dealt back by broadcast."""
    rows = groups(6, n=20) + [(1000 + i, [1.0] * 16) for i in range(300)] + [(5000 + i, None) for i in range(300)]
    assert sorted(r[:3] for r in run(spark, rows)) == sorted(brute(rows))


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    rows = [(i, (centre + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(120)]
    assert sorted(r[:3] for r in run(spark, rows)) == sorted(brute(rows))


def test_defined_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, v), (3, v), (3, v), (None, v), (7, [2.0, 4.0, 6.0, 8.0]), (8, [-1.0, -2.0, -3.0, -4.0]), (9, None), (10, [0.0] * 4), (11, [float("nan"), 1, 1, 1]), (12, [None, 1.0, 1.0, 1.0]), (13, [float("inf"), 1, 1, 1]), (14, [1.0, 2.0]), (None, None), (15, [1.0])]
    got = sorted(run(spark, rows), key=key)
    assert [r[:3] for r in got] == sorted(brute(rows), key=key)
    assert run(spark, []) == []


def test_hadamard_is_orthonormal():
    h = c.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_codes_probe_their_own_bucket_first():
    x = np.random.default_rng(0).normal(size=(50, 10))
    got = c.codes(x, c.Layout(2, 2, 4))
    assert got.shape == (50, 2, 4) and all(len(set(p)) == 4 for row in got for p in row)
    assert (c.codes(3 * x, c.Layout(2, 2, 4)) == got).all()


def test_query(spark, sf_dir):
    from gridloom.llm.queries import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries()["op7_crosspolytope"](spark, sf_dir).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(brute(rows))
