import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from gridloom.functions import elementwise as E
from gridloom.operators import array as array_module
from gridloom.operators import linalg
from gridloom.operators.array import NDArray, broadcast_shape, correlation


def lit(spark, x):
    return NDArray.literal(spark, x)


def value(df):
    return df.first()["v"]


def test_construction(spark):
    assert NDArray.eye(spark, 2).to_list() == [[1, 0], [0, 1]]
    assert NDArray.arange(spark, 0, 1, 0.25).to_list() == [0, 0.25, 0.5, 0.75]
    assert NDArray.arange(spark, 3, 0, -1).to_list() == [3, 2, 1]
    assert NDArray.linspace(spark, 1, 2, 3).to_list() == [1, 1.5, 2]
    assert NDArray.linspace(spark, 1, 2, 1).to_list() == [1]
    for bad in (lambda: NDArray.zeros(spark, (0, 2)), lambda: NDArray.arange(spark, 0, 1, 0), lambda: NDArray.arange(spark, 1, 0), lambda: NDArray.linspace(spark, 0, 1, 0), lambda: lit(spark, [[1], [1, 2]])):
        with pytest.raises(ValueError):
            bad()
    r = NDArray.random(spark, (20,), 1, 3, seed=1, integer=True).to_list()
    assert set(r) <= {1, 2, 3}
    assert NDArray.diag(lit(spark, [1, 2]), -1).to_list() == [[0, 0, 0], [1, 0, 0], [0, 2, 0]]


def test_access(spark):
    a = lit(spark, [[1, 2], [3, 4]])
    assert a.at(1, 0) == 3 and a.offset((1, 1)) == 3 and a.size == 4 and not a.empty
    with pytest.raises(IndexError):
        a.at(2, 0)
    assert str(lit(spark, [1, 2])) == "[1, 2]"
    assert lit(spark, [-2.7, 2.7]).as_type("int").to_list() == [-2, 2]


def test_elementwise_errors(spark):
    a = lit(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert (a * a - a + 2 / 1).to_list() == [[2, 4], [8, 14]]
    with pytest.raises(ZeroDivisionError):
        a / 0
    with pytest.raises(ValueError):
        a + lit(spark, [1, 2])
    for f, x in ((E.log, 0.0), (E.sqrt, -1.0), (E.arcsin, 2.0), (E.arccos, -2.0)):
        with pytest.raises(PySparkException):
            lit(spark, [x]).map(f).df.collect()
    with pytest.raises(PySparkException):
        (a / lit(spark, [[1.0, 0.0], [1.0, 1.0]])).df.collect()
    assert lit(spark, [-2.5, 2.5]).map(E.round_half_away).to_list() == [-3, 3]


def test_broadcasting(spark):
    a, row = lit(spark, [[1, 2], [3, 4]]), lit(spark, [10, 20])
    assert a.zip(row, lambda x, y: x + y).to_list() == [[11, 22], [13, 24]]
    col = lit(spark, [[10], [20]])
    assert a.zip(col, lambda x, y: x + y).to_list() == [[11, 12], [23, 24]]
    assert a.broadcastable(row) and not a.broadcastable(lit(spark, [1, 2, 3]))
    assert row.broadcast_to((2, 2)).to_list() == [[10, 20], [10, 20]]
    assert broadcast_shape((3, 1), (4,)) == (3, 4)


def test_statistics(spark):
    assert value(lit(spark, [1, 2, 4]).percentile(30)) == pytest.approx(1.6)
    assert lit(spark, [1, 2, 2, 3, 5]).histogram(4).to_list() == [1, 2, 1, 1]
    assert lit(spark, [2, 2]).histogram(3).to_list() == [2, 0, 0]
    assert lit(spark, [0, 1, 1, 3]).bincount().to_list() == [1, 2, 0, 1]
    with pytest.raises(ValueError):
        lit(spark, [-1]).bincount()
    assert lit(spark, [0.5, 1, 2.5]).digitize([1, 2]).to_list() == [0, 1, 2]
    assert value(lit(spark, [3, 3, 1]).argmax()) == 0
    a = lit(spark, [[1, 5], [4, 2]])
    assert a.argmax(0).to_list() == [1, 0] and a.argmin(1).to_list() == [0, 1]
    assert a.sum(1).to_list() == [6, 6] and a.median(0).to_list() == [2.5, 3.5]
    assert a.any(0).to_list() == [True, True] and value(a.all())
    with pytest.raises(ValueError):
        lit(spark, [1]).variance()
    assert value(a.trace()) == 3
    with pytest.raises(PySparkException):
        value(correlation(lit(spark, [1, 1]), lit(spark, [1, 2])))
    assert linalg.covariance(lit_columns(spark), ["a", "b"]).count() == 4


def lit_columns(spark):
    return spark.createDataFrame([(1.0, 2.0), (3.0, 6.0), (5.0, 7.0)], "a double, b double")


def test_scans(spark, monkeypatch):
    x = lit(spark, [1, 2, 3, 4])
    assert x.cumsum().to_list() == [1, 3, 6, 10] and x.cumprod().to_list() == [1, 2, 6, 24]
    monkeypatch.setattr(array_module, "SCAN_BLOCK", 2)
    assert x.cumsum().to_list() == [1, 3, 6, 10] and x.cumprod().to_list() == [1, 2, 6, 24]
    assert lit(spark, [[1, 2], [3, 4], [5, 6]]).cumsum(0).to_list() == [[1, 2], [4, 6], [9, 12]]
    y = lit(spark, [1, 4, 9, 16])
    assert y.diff(2).to_list() == [8, 12] and y.gradient().to_list() == [3, 4, 6, 7] and y.diff(9).to_list() == [0]
    assert value(lit(spark, [0, 1, 4]).trapz(lit(spark, [0, 1, 2]))) == 3
    assert value(lit(spark, [0, 1, 4]).trapz()) == 3


def test_sorting(spark):
    a = lit(spark, [[3, 1], [2, 4]])
    assert a.sort().to_list() == [[1, 2], [3, 4]] and a.sort(0).to_list() == [[2, 1], [3, 4]] and a.sort(1).to_list() == [[1, 3], [2, 4]]
    assert a.argsort().to_list() == [1, 2, 0, 3] and a.argsort(1).to_list() == [[1, 0], [0, 1]]


def test_reshaping(spark):
    a = lit(spark, [[1, 2], [3, 4]])
    assert a.rotate90().to_list() == [[3, 1], [4, 2]] and a.rotate90(4).equals(a) and a.flip().flip().equals(a)
    assert a.reshape((4,)).reshape((2, 2)).equals(a) and a.flatten().to_list() == [1, 2, 3, 4]
    assert a.concatenate(a, 1).to_list() == [[1, 2, 1, 2], [3, 4, 3, 4]] and a.stack(a).shape == (2, 2, 2)
    parts = a.split(2)
    assert parts[0].concatenate(parts[1]).equals(a)
    assert a.repeat(2, None).to_list() == [1, 1, 2, 2, 3, 3, 4, 4] and lit(spark, [1, 2]).repeat(2).to_list() == [1, 1, 2, 2]
    assert a.expand_dims(1).squeeze().equals(a) and lit(spark, [[5]]).squeeze().shape == (1,)
    assert lit(spark, [1, 2]).pad([(1, 2)], "edge").to_list() == [1, 1, 2, 2, 2]
    assert lit(spark, [7]).pad([(1, 1)], "edge").to_list() == [7, 7, 7]
    assert a.pad([(1, 0), (0, 1)]).to_list() == [[0, 0, 0], [1, 2, 0], [3, 4, 0]]
    three = NDArray.arange(spark, 0, 24).reshape((2, 3, 4))
    assert three.swapaxes(0, 2).shape == (4, 3, 2) and three.slice([(1, 2), (0, 1), (2, 4)]).to_list() == [[[14, 15]]]
    assert a.is_square() and not a.is_symmetric() and NDArray.eye(spark, 3).is_diagonal()
    assert not lit(spark, [float("nan")]).equals(lit(spark, [float("nan")]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=2, max_size=4))
def test_against_numpy(spark, xs):
    a, x = lit(spark, xs), np.array(xs, float)
    assert linalg.to_numpy(a.transpose()).tolist() == x.T.tolist()
    assert linalg.to_numpy(linalg.matmul(a, a.transpose())).tolist() == (x @ x.T).tolist()
    assert linalg.to_numpy(a.sum(0)).tolist() == x.sum(0).tolist()
    assert linalg.to_numpy(a.sort(1)).tolist() == np.sort(x, 1).tolist()


def test_linear_algebra(spark):
    a = lit(spark, [[4, 7], [2, 6]])
    assert np.allclose(linalg.to_numpy(linalg.inverse(a)), [[0.6, -0.7], [-0.2, 0.4]])
    assert linalg.determinant(a) == pytest.approx(10)
    low, up, p = (linalg.to_numpy(m) for m in linalg.lu(a))
    assert np.allclose(low, [[1, 0], [0.5, 1]]) and np.allclose(up, [[4, 7], [0, 2.5]]) and np.allclose(p, np.eye(2))
    with pytest.raises(ValueError, match="singular"):
        linalg.inverse(lit(spark, [[1, 2], [2, 4]]))
    assert linalg.determinant(lit(spark, [[1, 2], [2, 4]])) == 0 and linalg.rank(lit(spark, [[0, 1], [0, 0]])) == 1
    assert linalg.determinant(lit(spark, [[0, 1], [1, 0]])) == pytest.approx(-1)
    values, vectors = linalg.eigen(lit(spark, [[2, 1], [1, 2]]))
    assert np.allclose(values, [3, 1]) and np.allclose(np.abs(vectors), math.sqrt(0.5))
    with pytest.raises(ValueError, match="complex"):
        linalg.eigen(lit(spark, [[0, -1], [1, 0]]))
    x = lit(spark, [[1, 2], [3, 4], [5, 6]])
    u, s, vt = linalg.svd(x)
    u, vt = linalg.to_numpy(u), linalg.to_numpy(vt)
    assert np.allclose(u * s @ vt, [[1, 2], [3, 4], [5, 6]])


def test_convolution(spark):
    a, k = lit(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]]), [[1, 0], [0, -1]]
    assert linalg.convolve(a, k, "valid").to_list() == [[4, 4], [4, 4]]
    assert linalg.convolve(a, k, "same").to_list() == [[1, 2, 3], [4, 4, 4], [7, 4, 4]]
    assert linalg.convolve(a, k).to_list() == [[1, 2, 3, 0], [4, 4, 4, -3], [7, 4, 4, -6], [0, -7, -8, -9]]
