import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators.frame import Frame

NAN = float("nan")


@pytest.fixture(scope="module")
def small(spark):
    return Frame.from_columns(spark, {"a": [3, 1, 2, 5], "b": [1, 1, 2, 2]})


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_construction_checks(spark):
    with pytest.raises(ValueError):
        Frame.from_columns(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(ValueError):
        Frame.from_columns(spark, {"a": [NAN]})
    with pytest.raises(ValueError):
        Frame.empty(spark, ["a", "a"])
    assert Frame.empty(spark, ["a", "b"]).shape() == (0, 2)


def test_projection(small):
    assert small.select(["b", "a", "b"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        small.select([])
    with pytest.raises(KeyError):
        small.select(["zz"])
    with pytest.raises(ValueError):
        small.add_column("a", F.lit(1))
    assert "c" in small.add_column("c", F.col("a") + 1).columns
    assert small.remove_column("b").columns == ["a"]
    with pytest.raises(KeyError):
        small.remove_column("zz")
    assert small.rename_column("a", "a") is small
    with pytest.raises(ValueError):
        small.rename_column("a", "b")
    assert rows(small.apply("a", lambda c: c * 2).df, "a") == [(2,), (4,), (6,), (10,)]
    assert small.apply_all(lambda c: c * 0).df.agg(F.sum("a")).first()[0] == 0


def test_rows_by_position(small):
    assert [r["a"] for r in small.head(2).df.orderBy("_rid").collect()] == [3, 1]
    assert [r["a"] for r in small.tail(2).df.orderBy("_rid").collect()] == [2, 5]
    assert rows(small.slice(1, 3).df, "a") == [(1,), (2,)]
    with pytest.raises(ValueError):
        small.slice(2, 2)
    assert rows(small.remove_row(0).df, "a") == [(1,), (2,), (5,)]
    with pytest.raises(IndexError):
        small.remove_row(9)
    assert [r["a"] for r in small.sort("a", ascending=False).collect()] == [5, 3, 2, 1]
    assert small.add_row({"_rid": 4, "a": 9.0, "b": 9.0}).rows() == 5


def test_empty_keeps_schema(spark):
    f = Frame.empty(spark, ["a"])
    f = Frame(f.df, ["a"])
    assert f.head(3).columns == ["a"] and f.filter(F.col("a") > 0).columns == ["a"]
    assert f.mean().first()["a"] == 0.0
    assert f.to_matrix().shape == (0, 1)


def test_statistics_skip_missing(spark):
    f = Frame(spark.createDataFrame([(0, 1.0), (1, NAN), (2, 3.0), (3, 8.0), (4, None)], "k int, v double"), ["k"])
    got = {n: f.stat(n, ["v"]).first()["v"] for n in ("mean", "median", "stddev", "variance", "min", "max")}
    assert got["mean"] == 4 and got["median"] == 3 and got["variance"] == pytest.approx(13) and got["min"] == 1 and got["max"] == 8
    assert got["stddev"] == pytest.approx(3.605551, abs=1e-6)
    assert {r["column"]: r["missing"] for r in f.is_na().collect()} == {"k": 0, "v": 2}
    assert f.drop_na().rows() == 3
    assert not any(math.isnan(r["v"]) for r in f.fill_na(0.0).df.collect())


def test_interpolate_across_blocks(spark):
    f = Frame(spark.createDataFrame([(0, None), (1, 1.0), (2, NAN), (3, None), (4, 7.0), (5, None)], "k int, v double"), ["k"])
    for block in (1, 2, 100):
        got = [r["v"] for r in f.interpolate(["v"], "k", block).df.orderBy("k").collect()]
        assert got == [None, 1.0, 3.0, 5.0, 7.0, None]


def test_joins(spark, small):
    other = Frame(spark.createDataFrame([(1.0, 10), (7.0, 70)], "a double, b int"))
    assert rows(small.merge(other, "a").df, "a", "b_x", "b_y") == [(1.0, 1.0, 10)]
    assert small.merge(other, "a", "outer").rows() == 5
    assert small.merge(other, "a", "left_anti").rows() == 3
    with pytest.raises(ValueError):
        small.merge(other, "a", "sideways")
    renamed = Frame(other.df.withColumnRenamed("a", "z"))
    assert small.join(renamed, "a", "z").rows() == 1


def test_grouping(small, spark):
    assert rows(small.group_by("b", F.sum, ["a"]), "b", "a") == [(1.0, 4.0), (2.0, 7.0)]
    assert rows(small.value_counts(["b"]), "value", "n") == [("1.0", 2), ("2.0", 2)]
    assert rows(small.drop_duplicates(["b"]).df, "a", "b") == [(2.0, 2.0), (3.0, 1.0)]
    assert small.select(["b"]).unique().rows() == 2
    long = Frame(spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, "x", 7)], "i int, c string, v int"))
    assert rows(long.pivot("i", "c", "v", ["x", "y"]), "i", "x") == [(1, 5), (2, 7)]
    twice = Frame(long.df.union(long.df))
    with pytest.raises(Exception, match="repeated"):
        twice.pivot("i", "c", "v", ["x", "y"]).collect()


def test_scaling(small):
    assert sorted(r["a"] for r in small.normalize(["a"]).df.collect()) == [0.0, 0.25, 0.5, 1.0]
    assert sum(r["a"] for r in small.standardize(["a"]).df.collect()) == pytest.approx(0)
    hot = small.one_hot_encode("b")
    assert hot.columns == ["a", "b_1.0", "b_2.0"]


def test_concat_and_matrix(small):
    assert Frame.concat([small, small]).rows() == 8
    side = Frame.concat([small.select(["_rid", "a"]), small.select(["_rid", "b"])], "1")
    assert side.rows() == 4
    m = small.to_matrix(["a", "b"])
    assert m.to_list() == [[3, 1], [1, 1], [2, 2], [5, 2]]
    back = Frame.from_matrix(m, ["x", "y"])
    assert rows(back.df, "_rid", "x") == [(0, 3), (1, 1), (2, 2), (3, 5)]
    assert "rows: 4" in small.info()
