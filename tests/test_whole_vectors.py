"""The queries over embeddings that have no SQL, against numpy on all components."""

import numpy as np
import pytest

from gridloom.plans import catalog


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def test_pca(spark, sf_dir, data):
    ids, _, x = data
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    axes = vectors[:, np.argsort(-values)[:2]]
    axes *= np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    got = {r["vec_id"]: (r["pc0"], r["pc1"]) for r in catalog.queries()["pca"](spark, sf_dir).collect()}
    assert np.allclose([got[i] for i in ids], centred @ axes, atol=1e-5)


def test_silhouette(spark, sf_dir, data):
    _, y, x = data
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    means = np.array([[d[i, y == c].sum() / (np.sum(y == c) - (y[i] == c)) for c in np.unique(y)] for i in range(len(x))])
    own = np.unique(y)[None] == y[:, None]
    a, b = means[own], np.where(own, np.inf, means).min(1)
    assert catalog.queries()["silhouette"](spark, sf_dir).first()["v"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-5)


def test_kmeans_fit(spark, sf_dir, data):
    ids, _, x = data
    got = {r["vec_id"]: r["prediction"] for r in catalog.queries()["kmeans_fit"](spark, sf_dir).collect()}
    at = np.array([got[i] for i in ids])
    centres = np.array([x[at == c].mean(0) for c in range(3)])
    # ten of Lloyd's rounds: nearly every row is with the nearest mean of its whole vectors
    assert (((x[:, None] - centres) ** 2).sum(2).argmin(1) == at).mean() > 0.9
