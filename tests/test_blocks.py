"""Sums of blocks, tiles, triangles, cells and bounds against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions import metrics
from gridloom.operators import linalg, neighbors, tsqr
from gridloom.operators.blocks import Vectors, moments
from gridloom.operators.cluster import KMeans, squares
from gridloom.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor
from gridloom.operators.tiles import Tiles

rng = np.random.default_rng(12)


def frame(spark, x, parts=5):
    """Rows (p, a0, a1, ..) of a matrix."""
    names = [f"a{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "p long, " + ", ".join(f"{n} double" for n in names)).repartition(parts), names


def array(spark, x):
    return linalg.from_numpy(spark, np.asarray(x, float))


def numbers(t):
    return linalg.to_numpy(t.to_array())


# moments


@pytest.mark.parametrize(("n", "d"), [(1, 3), (2, 1), (400, 7), (60, 40)])
def test_moments(spark, n, d):
    x = rng.normal(1e6, 1, size=(n, d))
    df, names = frame(spark, x)
    rows, mean, about = moments(df, names)
    assert rows == n and np.allclose(mean, x.mean(0)) and np.allclose(about, (x - x.mean(0)).T @ (x - x.mean(0)), atol=1e-6)
    g = linalg.gram(df, names)
    one = np.column_stack((np.ones(n), x))
    assert np.allclose(g, one.T @ one)


def test_moments_leave_out_rows_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (float("nan"), 1.0), (3.0, 4.0)], "a double, b double")
    rows, mean, _ = moments(df, ["a", "b"])
    assert rows == 2 and mean.tolist() == [2, 3] and moments(df.limit(0), ["a", "b"])[0] == 0


# tiles


@pytest.mark.parametrize(("n", "k", "m", "side", "span", "shares"), [(7, 5, 9, 2, 2, None), (20, 33, 11, 4, 1, 3), (3, 40, 3, 8, 4, None), (1, 1, 1, 5, 4, None), (9, 6, 9, 3, 2, 1), (50, 2, 50, 7, 3, 2)])
def test_products(spark, n, k, m, side, span, shares):
    x, y = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    a, b = Tiles.of_array(array(spark, x), side), Tiles.of_array(array(spark, y), side)
    assert np.allclose(numbers(a.matmul(b, span, shares)), x @ y)
    assert (numbers(b.transpose()) == y.T).all() and (numbers(a.map(np.negative)) == -x).all()
    assert np.allclose(numbers(b.transpose().matmul(a.transpose())), (x @ y).T)


def test_tiles_of_rows_and_defined_cases(spark):
    x = rng.normal(size=(37, 9))
    df, names = frame(spark, x)
    t = Tiles.of_rows(df, "p", names, 37, 4)
    assert (numbers(t) == x).all() and t.layout.grid == (10, 3) and t.df.count() == 30
    assert np.allclose(numbers(t.transpose().matmul(t)), x.T @ x)
    odd = array(spark, [[1.0, np.inf], [np.nan, 0.0]])
    got = numbers(Tiles.of_array(odd, 1).matmul(Tiles.of_array(array(spark, [[1.0], [0.0]]), 1)))
    assert np.isnan(got).all()  # infinity times zero, and NaN
    with pytest.raises(ValueError):
        t.matmul(t)
    with pytest.raises(ValueError):
        Tiles(df, (0, 3))


def test_products_move_tiles_not_cells(spark):
    """The shuffle before the product has a row for each copy of a tile."""
    t = Tiles.of_rows(*frame(spark, rng.normal(size=(64, 8)))[:1], "p", [f"a{j}" for j in range(8)], 64, 8)
    plan = t.transpose().matmul(t, span=1, shares=2).df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


@pytest.mark.parametrize(("n", "k", "m"), [(37, 3, 4), (1, 1, 1), (37, 4, 9), (50, 4, 2)])
def test_tall_matrices_stay_where_they_lie(spark, n, k, m):
    """No tile of the tall side is dealt out again, by the product with a small matrix or by the Gram matrix."""
    x, y = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    a, b = Tiles.of_array(array(spark, x), 4), Tiles.of_array(array(spark, y), 4)
    assert np.allclose(numbers(a.matmul(b)), x @ y) and np.allclose(numbers(a.matmul(b).gram()), (x @ y).T @ (x @ y))
    shuffles = lambda t: t.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(ti")
    assert shuffles(a.matmul(b)) == shuffles(a) + shuffles(b) and shuffles(a.gram()) == shuffles(a)


# triangles


@pytest.mark.parametrize(("n", "d"), [(200, 6), (6, 6), (4, 6), (1, 1), (3000, 3)])
def test_triangle_and_singular_values(spark, n, d):
    x = rng.normal(size=(n, d))
    df, names = frame(spark, x, 7)
    r = tsqr.triangle(df, names)
    assert np.allclose(r.T @ r, x.T @ x) and (np.diag(r) >= 0).all() and np.allclose(r, np.triu(r))
    s = np.zeros(d)
    s[: min(n, d)] = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(tsqr.singular_values(df, names), s, atol=1e-12)


def test_svd_of_dependent_columns(spark):
    x = rng.normal(size=(300, 5))
    x[:, 4] = 2 * x[:, 0] - x[:, 1]
    df, names = frame(spark, x)
    left, s, vt = tsqr.svd(df, names)
    u = np.array([r["u"] for r in left.orderBy("p").collect()])
    assert np.allclose(u * s @ vt, x) and np.allclose(u[:, :4].T @ u[:, :4], np.eye(4)) and (u[:, 4] == 0).all()
    assert tsqr.rank(df, names) == 4 and left.columns == ["p", *names, "u"]
    with pytest.raises(ValueError, match="depend"):
        tsqr.qr(df, names)


def test_small_singular_values_keep_their_digits(spark):
    """1e-9 beside 1: its square would be lost in a Gram matrix."""
    q, _ = np.linalg.qr(rng.normal(size=(500, 3)))
    x = q * [1.0, 1e-5, 1e-9]
    df, names = frame(spark, x)
    assert np.allclose(tsqr.singular_values(df, names), [1, 1e-5, 1e-9], rtol=1e-5)
    assert tsqr.rank(df, names) == 3


def test_qr_and_array_columns(spark):
    x = rng.normal(size=(90, 4))
    df, names = frame(spark, x)
    packed = df.select("p", F.array(*names).alias("x"))
    rows, r = tsqr.qr(packed, Vectors("x", 4))
    q = np.array([row["q"] for row in rows.orderBy("p").collect()])
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(4))


def test_svd_of_arrays(spark):
    for shape in ((30, 4), (4, 30), (5, 5)):
        x = rng.normal(size=shape)
        u, s, vt = linalg.svd(array(spark, x))
        assert np.allclose(linalg.to_numpy(u) * s @ linalg.to_numpy(vt), x) and linalg.rank(array(spark, x)) == min(shape)


def test_a_million_rows(spark):
    """Singular values of a million rows that no driver sees, against their Gram matrix' closed form."""
    n = 1_000_000
    t = F.col("id") * (2 * np.pi / n)
    df = spark.range(n).select("id", (3 * F.cos(t)).alias("a"), F.sin(t).alias("b"), F.lit(0.5).alias("c"))
    assert np.allclose(tsqr.singular_values(df, ["a", "b", "c"]), np.sqrt([9 * n / 2, n / 2, n / 4]))
    assert tsqr.rank(df, ["a", "b", "c"], n) == 3


def test_missing_values_have_no_factors(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "a double")
    with pytest.raises(Exception, match="no factorisation"):
        tsqr.triangle(df, ["a"])


# neighbours


def brute_neighbors(train, asked, k):
    out = {}
    for q, x in asked:
        out[q] = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), t) for t, y in train)[:k]
    return out


@pytest.mark.parametrize(("d", "unit"), [(1, 50_000), (2, 7), (8, 40)])
def test_neighbors_equal_brute_force(spark, d, unit):
    """Clusters, copies, ties on a grid and a hot point that a third of all rows share."""
    x = np.round(rng.normal(size=(240, d)) * 2 + rng.integers(0, 4, size=(240, 1)) * 10, 1)
    x[::3] = x[0]
    train = [(i * 7 % 241, tuple(map(float, r))) for i, r in enumerate(x)]
    asked = [(1000 + i, tuple(map(float, np.round(rng.normal(size=d) * 8 + 10, 1)))) for i in range(25)] + [(2000, train[0][1])]
    schema = "k long, y int, " + ", ".join(f"a{j} double" for j in range(d))
    table = lambda rows: spark.createDataFrame([(i, i % 3, *v) for i, v in rows], schema).repartition(4)
    names = [f"a{j}" for j in range(d)]
    m = KNeighborsClassifier(names, "y", "k", 6, pivots=12, unit_rows=unit).fit(table(train))
    got = {}
    for r in m.neighbors(table(asked)).collect():
        got.setdefault(r["__q"], []).append((r["__r"], r["__d"], r["__t"], r["__y"]))
    for q, near in brute_neighbors(train, asked, 6).items():
        mine = sorted(got[q])
        assert [t for _, _, t, _ in mine] == [t for _, t in near] and np.allclose([f for _, f, _, _ in mine], [f for f, _ in near])
        assert all(y == t % 3 for _, _, t, y in mine)


def test_copies_of_queries_are_passed_on_in_small_batches():
    """However many cells every query visits, no batch of copies holds more than SENT cells; none is lost."""
    d, cells, asked = 64, 128, 600
    x = rng.normal(size=(cells, d))
    ones = np.ones(cells, np.int64)
    c = neighbors.Cells(x, ones, ones * np.inf, ones * 0.0, np.full((cells, 5), np.inf), np.arange(cells), ones)
    q = pa.RecordBatch.from_arrays([pa.array(range(asked)), pa.array(list(rng.normal(size=(asked, d))))], names=["__q", "__x"])
    got = list(neighbors._sent(c, True)(iter([q])))
    assert max(b.num_rows for b in got) * d <= neighbors.SENT
    pairs = {(u, k) for b in got for u, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert len(pairs) == sum(b.num_rows for b in got) == cells * asked


def test_far_cells_are_not_asked(spark):
    """Well separated groups: a query goes to its own group's cells only."""
    x = np.vstack([rng.normal(size=(100, 3)) + 1000 * g for g in range(6)])
    df, names = frame(spark, x)
    m = KNeighborsRegressor(names, "a0", "p", 3, pivots=24).fit(df)
    visited = m.cells.visited(x[:40])
    assert visited.any(axis=1).all() and visited.sum(axis=1).max() <= (m.cells.pivots[:, 0] < 500).sum() < len(m.cells.pivots)


def test_neighbors_defined_cases(spark):
    schema = "k long, x double, y double"
    train = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 9.0), (3, 2.0, 3.0), (4, float("nan"), 9.0)], schema)
    asked = spark.createDataFrame([(10, 1.0, 0.0), (11, None, 0.0), (10, 1.0, 0.0)], schema)
    got = KNeighborsRegressor(["x"], "y", "k", 5).fit(train).predict(asked).collect()
    assert sorted((r["k"], r["prediction"]) for r in got if r["k"] == 10) == [(10, 2.0)] * 2
    assert [r["prediction"] for r in got if r["k"] == 11] == [None]
    none = KNeighborsRegressor(["x"], "y", "k", 5).fit(train.limit(0)).predict(asked).collect()
    assert len(none) == 3 and all(r["prediction"] is None for r in none)


# clusters


def lloyd(x, centers, rounds):
    c = np.array(centers, float)
    for _ in range(rounds):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
    return c


@pytest.mark.parametrize("k", [1, 3, 20])
@pytest.mark.parametrize("bounds", [True, False])
def test_rounds_equal_plain_lloyd(spark, k, bounds):
    x = rng.normal(size=(400, 4)) + rng.integers(0, 5, size=(400, 1)) * 3
    df, names = frame(spark, x)
    m = KMeans(names, k, max_iter=7, tol=0.0, bounds=bounds).fit(df, x[:k])
    expected = lloyd(x, x[:k], 7)
    assert np.allclose(m.centers, expected) and m.scans == 7
    at = ((x[:, None] - m.centers) ** 2).sum(2).argmin(1)
    assert [r["prediction"] for r in m.predict(df).orderBy("p").collect()] == at.tolist()
    assert m.inertia(df).first()["v"] == pytest.approx(((x - m.centers[at]) ** 2).sum())


def test_bounds_spare_measurements(spark):
    centres = rng.normal(0, 50, size=(20, 5))
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 5))
    df, names = frame(spark, x)
    m = KMeans(names, 20, max_iter=6, tol=0.0).fit(df, centres + 0.5)
    assert m.measured[0] == 3000 and max(m.measured[1:]) < 300


def test_parallel_seeding(spark):
    centres = rng.normal(0, 100, size=(12, 4))
    x = centres[rng.integers(0, 12, 2400)] + rng.normal(size=(2400, 4))
    df, names = frame(spark, x)
    m = KMeans(names, 12, max_iter=5, init="parallel", seed=4).fit(df)
    again = KMeans(names, 12, max_iter=5, init="parallel", seed=4).fit(df.repartition(3))
    ideal = squares(x, centres).min(axis=1).sum()
    assert m.inertia(df).first()["v"] < 1.1 * ideal and np.allclose(m.centers, again.centers)
    assert m.scans <= 2 * m.init_rounds + 2 + 5  # two scans a seeding round, the first row, the weights, the rounds


def test_clusters_defined_cases(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, 4.0), (4, float("nan")), (5, 4.0)], "k int, x double")
    m = KMeans(["x"], 2, max_iter=3).fit(df, [[0.0], [4.0]])
    assert [r["prediction"] for r in m.predict(df).orderBy("k").collect()] == [0, None, 1, None, 1]
    with pytest.raises(ValueError, match="fewer rows"):
        KMeans(["x"], 9).fit(df)
    same = spark.createDataFrame([(i, 1.0) for i in range(8)], "k int, x double")
    assert KMeans(["x"], 2, init="parallel", max_iter=2).fit(same).centers.ravel().tolist() == [1.0, 1.0]


def test_silhouette_of_odd_tables(spark):
    rows = [(0.0, "a"), (1.0, "a"), (10.0, "b"), (None, "b"), (12.0, None)]
    df = spark.createDataFrame(rows, "x double, c string")
    # b has one row and scores 0; the others' distances to it are squared
    expected = np.mean([(100 - 1) / 100, (81 - 1) / 81, 0])
    assert metrics.silhouette(df, ["x"], "c").first()["v"] == pytest.approx(expected)
    assert metrics.silhouette(df.limit(0), ["x"], "c").first()["v"] is None
