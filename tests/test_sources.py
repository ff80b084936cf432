import pytest
from pyspark.sql import functions as F

from gridloom.operators.order import with_position
from gridloom.sources import files
from gridloom.streaming.running import running_statistics


def test_matrix_text(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("1 2\t3\n\n  4 5 6 oops 7\n")
    assert files.read_matrix(spark, str(p)).to_list() == [[1, 2, 3], [4, 5, 6]]
    p.write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        files.read_matrix(spark, str(p))
    p.write_text("\n")
    with pytest.raises(ValueError):
        files.read_matrix(spark, str(p))


def test_csv_json_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_json(df, str(tmp_path / "j"))
    files.write_parquet(df, str(tmp_path / "p"))
    expected = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "k int, s string").collect())) == expected
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c")).collect())) == expected
    assert sorted((r["k"], r["s"]) for r in files.read_json(spark, str(tmp_path / "j")).collect()) == expected
    assert sorted(map(tuple, files.read_parquet(spark, str(tmp_path / "p")).collect())) == expected


def test_positions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = with_position(df, ["k"]).orderBy("_rid").collect()
    assert [r["_rid"] for r in got] == list(range(1000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert with_position(spark.range(0), ["id"]).count() == 0


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v double").parquet(str(tmp_path / "in"))
    q = running_statistics(stream, ["v"]).writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        q.processAllAvailable()
        assert spark.table("running").first()["mean_v"] == 2.0 and spark.table("running").first()["n_v"] == 2
    finally:
        q.stop()
