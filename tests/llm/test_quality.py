import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import quality
from gridloom.llm.queries import queries


def min_max_isotonic(p, t):
    n = len(p)
    return [max(min(sum(p[a : b + 1]) / sum(t[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 5)), min_size=1, max_size=8))
def test_pool_adjacent_violators(pairs):
    t = np.array([a + b for a, b in pairs], float)
    p = np.array([a for a, _ in pairs], float)
    got, exact = quality.pool_adjacent_violators(p, t), min_max_isotonic(p, t)
    assert np.allclose(got, exact) and (np.diff(got) >= -1e-12).all()


def test_kernel_approximation():
    rng = np.random.default_rng(0)
    d, width = len(quality.STATISTICS), 4000
    m = quality.FourierRidge(np.zeros(d), np.ones(d), rng.normal(size=(d, width)) / 3, rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), (0, 1), np.zeros(quality.BINS))
    x = rng.normal(size=(5, d))
    f = m.features(x)[:, :-1]
    k = np.exp(-((x[:, None] - x) ** 2).sum(2) / 18)
    assert np.abs(f @ f.T - k).max() < 0.08


def test_statistics_are_finite():
    for text in (None, "", " ", "\n\n", "a", "!!!", "é" * 50, "x " * 5000, "\x00\x01"):
        x = quality.statistics(text)
        assert len(x) == len(quality.STATISTICS) and np.isfinite(x).all()


def test_defined_cases(docs_of, labels_of):
    rows = [(i, "good words in a calm line of prose. " * (1 + i % 3)) for i in range(40)] + [(100 + i, "BAD!! ### $$$ " * (2 + i % 4)) for i in range(40)] + [(None, None), (1000, ""), (1001, "z" * 100_000), (3, "good words in a calm line of prose. ")]
    labels = labels_of([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 1), (5, None, None), (7, 1, 0)])
    got = quality.quality_scores(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == 1 for r in got if r["doc_id"] is not None and r["doc_id"] < 40]) == 1
    assert np.mean([r["predicted"] == 0 for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 140]) == 1
    assert {r["score"] for r in quality.quality_scores(docs_of(rows), labels_of([])).collect()} == {0.5}
    assert quality.quality_scores(docs_of([]), labels).count() == 0


@pytest.mark.parametrize("name,label,recall,rejects,right", [("op3_quality", "quality", 0.97, 0.9, 0.97), ("op4_toxicity", "toxic", 0.75, 0.95, 0.85)])
def test_held_out_quality(spark, name, label, recall, rejects, right):
    """Held-out rows of both classes: recall of class 1, share of class 0 left alone, and precision, not bare accuracy."""
    import zlib

    sf_dir = "/root/testdata/sf0.1"
    rows = queries()[name](spark, sf_dir).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    hits, bad, said = (sum(f(p, y) for p, y in held) for f in (lambda p, y: p and y, lambda p, y: not p and not y, lambda p, y: p))
    ones = sum(y for _, y in held)
    figures = hits / ones, bad / (len(held) - ones), hits / said
    print(name, "base rate", round(ones / len(held), 3), "recall, left alone, precision", [round(x, 3) for x in figures])
    assert figures[0] >= recall and figures[1] >= rejects and figures[2] >= right, figures


def test_calibration_is_out_of_fold(spark):
    """Sums by folds give the weights that a direct solution gives, and every learning row is calibrated once."""
    rng = np.random.default_rng(4)
    d = len(quality.STATISTICS)
    x = rng.normal(size=(400, d))
    y = (x[:, 0] > 0).astype(int)
    fold = rng.integers(0, quality.FOLDS, 400)
    rows = spark.createDataFrame([(v.tolist(), int(a), int(b)) for v, a, b in zip(x, y, fold)], "x array<double>, label int, fold int")
    m = quality.fit(rows.repartition(30), width=32)
    f = m.features(x)
    penalty = np.eye(33)
    penalty[-1, -1] = 1e-6
    assert np.allclose(m.weights, np.linalg.solve(f.T @ f + penalty, f.T @ y))
    raw = np.empty(400)
    for k in range(quality.FOLDS):
        g = f[fold != k]
        raw[fold == k] = f[fold == k] @ np.linalg.solve(g.T @ g + penalty, g.T @ y[fold != k])
    at = m.bins(raw)
    expected = quality.pool_adjacent_violators(np.bincount(at, weights=y, minlength=quality.BINS), np.bincount(at, minlength=quality.BINS))
    assert np.allclose(m.steps, expected, atol=1e-6)
