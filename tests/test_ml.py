import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import metrics
from gridloom.operators.cluster import KMeans
from gridloom.operators.decomposition import PCA
from gridloom.operators.linear import Lasso, LinearRegression, LogisticRegression, Ridge
from gridloom.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor
from gridloom.operators.optim import Adam, GradientDescent, StochasticGradientDescent
from gridloom.operators.preprocessing import MinMaxScaler, NotFitted, OneHotEncoder, StandardScaler, normalize_rows, polynomial_features
from gridloom.operators.selection import cross_val_linear, cross_val_score, select_k_best, train_test_split


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in (1, 2, 3)], "k int, x double, y double")


def column(df, name, by="k"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_scalers(line, spark):
    s = StandardScaler(["x"])
    with pytest.raises(NotFitted):
        s.transform(line)
    assert np.allclose(column(s.fit_transform(line), "x"), [-1.224745, 0, 1.224745])
    assert np.allclose(column(s.inverse_transform(s.transform(line)), "x"), [1, 2, 3])
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double")
    assert column(MinMaxScaler(["x"]).fit_transform(flat), "x") == [0, 0] and column(StandardScaler(["x"]).fit_transform(flat), "x") == [0, 0]
    assert column(MinMaxScaler(["x"], -1, 1).fit_transform(line), "x") == [-1, 0, 1]
    rows = spark.createDataFrame([(1, 3.0, -4.0), (2, 0.0, 0.0)], "k int, a double, b double")
    assert column(normalize_rows(rows, ["a", "b"]), "b") == [-0.8, 0.0]
    with pytest.raises(ValueError):
        normalize_rows(rows, ["a"], "l9")


def test_encoding(spark):
    df = spark.createDataFrame([(1, 7), (2, 5), (3, 7)], "k int, c int")
    e = OneHotEncoder(["c"]).fit(df)
    hot = e.transform(df)
    assert hot.columns == ["k", "c_5", "c_7"] and column(hot, "c_7") == [1, 0, 1]
    assert column(e.inverse_transform(hot), "c") == [7, 5, 7]
    unseen = e.transform(spark.createDataFrame([(1, 99)], "k int, c int"))
    assert (column(unseen, "c_5"), column(e.inverse_transform(unseen), "c")) == ([0.0], [5])
    p = polynomial_features(spark.createDataFrame([(2.0, 3.0)], "a double, b double"), ["a", "b"], 2)
    assert p.first().asDict() == {"a": 2, "b": 3, "1": 1, "a*a": 4, "a*b": 6, "b*b": 9}


def test_linear_models(line):
    m = LinearRegression(["x"], "y").fit(line)
    assert (m.intercept, m.coef[0]) == (pytest.approx(1), pytest.approx(2)) and m.score(line).first()["v"] == pytest.approx(1)
    r = Ridge(["x"], "y", alpha=1.0).fit(line)
    assert (r.intercept, r.coef[0]) == (pytest.approx(2.333333, abs=1e-6), pytest.approx(1.333333, abs=1e-6))
    a = Lasso(["x"], "y", alpha=0.5).fit(line)
    assert (a.intercept, a.coef[0]) == (5, pytest.approx(0.178571, abs=1e-6))
    with pytest.raises(ValueError, match="singular"):
        LinearRegression(["x", "z"], "y").fit(line.withColumn("z", F.col("x")))


def test_logistic(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1)], "k int, x double, y int")
    m = LogisticRegression(["x"], "y", lr=0.1, max_iter=1).fit(df)
    assert (m.intercept, m.coef[0]) == (pytest.approx(0), pytest.approx(0.025))
    m = LogisticRegression(["x"], "y", lr=5.0, max_iter=40).fit(df)
    assert m.score(df).first()["v"] == 1 and column(m.predict(df), "prediction") == [0, 1]


def test_kmeans_and_pca(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate((0, 1, 10, 11))], "k int, x double")
    m = KMeans(["x"], 2, max_iter=1).fit(df, [[0.0], [10.0]])
    assert m.centers.ravel().tolist() == [0.5, 10.5] and column(m.predict(df), "prediction") == [0, 0, 1, 1]
    assert m.inertia(df).first()["v"] == 1.0
    assert KMeans(["x"], 2, seed=3).fit_predict(df).select("prediction").distinct().count() == 2
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3)) @ np.diag([3, 2, 0.5])
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, a double, b double, c double")
    p = PCA(["a", "b", "c"], 3).fit(wide)
    assert np.allclose(p.explained_variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]) and p.explained_variance_ratio.sum() == pytest.approx(1)
    assert np.allclose(column(p.inverse_transform(p.transform(wide)), "a"), x[:, 0])


def test_neighbors(spark):
    train = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 5.0, 1), (4, 6.0, 1)], "k int, x double, y int")
    test = spark.createDataFrame([(10, 0.4, 0), (11, 5.4, 1)], "k int, x double, y int")
    c = KNeighborsClassifier(["x"], "y", "k", 2).fit(train)
    assert column(c.predict(test), "prediction") == [0, 1] and c.score(test).first()["v"] == 1
    assert column(KNeighborsRegressor(["x"], "y", "k", 4).fit(train).predict(test), "prediction") == [0.5, 0.5]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    y, p = F.col("y"), F.col("p")
    got = df.agg(metrics.precision(y, p).alias("a"), metrics.recall(y, p).alias("b"), metrics.f1(y, p).alias("c"), metrics.accuracy(y, p).alias("d"), metrics.precision(y, p, 9).alias("e")).first()
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3), 0.6, 0.0)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 9.0)], "y double, p double")
    assert flat.agg(metrics.r2(F.col("y"), F.col("p"))).first()[0] == 1
    assert metrics.adjusted_rand(df.selectExpr("y a", "1 - y b"), "a", "b").first()["v"] == 1
    pts = spark.createDataFrame([(0.0, 0), (1.0, 0), (10.0, 1), (11.0, 1)], "x double, c int")
    s = metrics.silhouette(pts, ["x"], "c").first()["v"]
    x, c = np.array([0, 1, 10, 11.0]), np.array([0, 0, 1, 1])
    d = (x[:, None] - x) ** 2
    a = np.array([d[i, (c == c[i])].sum() / ((c == c[i]).sum() - 1) for i in range(4)])
    b = np.array([d[i, c != c[i]].mean() for i in range(4)])
    assert s == pytest.approx(((b - a) / np.maximum(a, b)).mean())


def test_selection_and_optimisers(spark):
    df = spark.range(200).withColumn("x", F.col("id") * 1.0).withColumn("n", F.rand(1)).withColumn("y", F.col("x") * 3)
    train, test = train_test_split(df, "id", 0.25, seed=2)
    assert train.count() + test.count() == 200 and 30 < test.count() < 70
    assert [r["feature"] for r in select_k_best(df, ["n", "x"], "y", 1).collect()] == ["x"]
    cv = cross_val_score(lambda t: LinearRegression(["x"], "y").fit(t), lambda m, t: m.score(t).first()["v"], df, "id", 2)
    assert cv["mean_test_score"] == pytest.approx(1)
    goal = np.array([1.0, -2.0])
    cost, grad = lambda x: ((x - goal) ** 2).sum(), lambda x: 2 * (x - goal)
    assert np.allclose(GradientDescent(lr=0.1).minimize(cost, grad, [0, 0]), goal, atol=1e-3)
    assert np.allclose(Adam(lr=0.05, max_iter=2000).minimize(cost, grad, [0, 0]), goal, atol=1e-2)
    step = lambda rows, x: 2 * (x - rows.mean(axis=0))
    assert StochasticGradientDescent(lr=0.4, max_iter=8, batch_size=100).minimize(df, "id", ["x"], step, [0])[0] == pytest.approx(99.5, abs=1)


@pytest.mark.parametrize("workers", [1, 3])
def test_batches_are_walked_in_one_scan_a_pass(spark, workers):
    """Every worker walks its batches in order; models are averaged by rows."""
    rng = np.random.default_rng(1)
    y = rng.normal(size=103)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double").repartition(5)
    m = StochasticGradientDescent(lr=0.3, max_iter=4, batch_size=10, tol=0.0, workers=workers)
    got = m.minimize(df, "id", ["y"], lambda rows, x: 2 * (x - rows.mean(axis=0)), [5.0])
    batches = 11
    x = 5.0
    for _ in range(4):
        models = []
        for w in range(workers):
            at, n = x, 0
            for b in (b for b in range(batches) if b * workers // batches == w):
                at -= 0.3 * 2 * (at - y[b::batches].mean())
                n += len(y[b::batches])
            models.append((n, at))
        x = sum(n * at for n, at in models) / sum(n for n, _ in models)
    assert got[0] == pytest.approx(x) and m.scans == 5


@pytest.mark.parametrize("workers", [1, 3])
def test_large_batches_are_taken_in_pieces(spark, workers):
    """No call of the gradient sees more rows than a piece, and the model is that of whole batches."""
    y = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(7, None)], "id long, y double").repartition(5)

    def gradient(rows, x):
        assert len(rows) <= 20 and rows.shape[1] == 2
        return 2 * (x - rows[:, :1].mean(axis=0))

    whole = lambda rows, x: 2 * (x - rows[:, :1].mean(axis=0))
    m = StochasticGradientDescent(lr=0.3, max_iter=3, batch_size=100, tol=0.0, workers=workers, piece_rows=20)
    got = m.minimize(df, "id", ["y", "id"], gradient, [5.0])  # more columns than parameters
    plain = StochasticGradientDescent(lr=0.3, max_iter=3, batch_size=100, tol=0.0, workers=workers).minimize(df, "id", ["y", "id"], whole, [5.0])
    assert got[0] == pytest.approx(plain[0], rel=1e-12) and m.scans == 4


def test_cross_validation_from_sums(spark):
    """The same scores as by fitting and scoring every fold's rows, with one scan."""
    rng = np.random.default_rng(5)
    x = rng.normal(50, 3, size=(120, 2))
    y = x @ [2.0, -1.0] + 7 + rng.normal(size=120)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double").repartition(4)
    plain = cross_val_score(lambda t: LinearRegression(["a", "b"], "y").fit(t), lambda m, t: m.score(t).first()["v"], df, "id", 4)
    sums = cross_val_linear(df, ["a", "b"], "y", "id", 4)
    for k in plain:
        assert np.allclose(sums[k], plain[k])
    odd = df.unionByName(spark.createDataFrame([(500, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], df.schema))
    assert np.allclose(cross_val_linear(odd, ["a", "b"], "y", "id", 4)["test_scores"], sums["test_scores"])
    with pytest.raises(ValueError, match="no rows"):
        cross_val_linear(df.where("id % 4 <> 1"), ["a", "b"], "y", "id", 4)
