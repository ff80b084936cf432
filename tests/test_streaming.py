"""Quantile sketches over streams, against exact ranks."""

import datetime

import numpy as np
import pytest

from gridloom.streaming.running import running_quantiles, windowed_quantiles


def rank_error(values, answer, p):
    """How far the answer's ranks are from p, as a share of the values."""
    values = np.sort(values)
    low, high = np.searchsorted(values, answer) / len(values), np.searchsorted(values, answer, "right") / len(values)
    return max(0.0, low - p, p - high)


def stream_of(spark, tmp_path, frames, schema):
    """A stream that takes one of the frames as each micro-batch."""
    for i, f in enumerate(frames):
        f.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name)


def test_running_quantiles(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.lognormal(size=30_000)
    rows = [(float(x), 7.0, None) for x in v]
    parts = [spark.createDataFrame(rows[i::3], "v double, same double, none double") for i in range(3)]
    extra = spark.createDataFrame([(None, 7.0, None), (float("nan"), 7.0, None)], "v double, same double, none double")
    stream = stream_of(spark, tmp_path, [*parts, extra], extra.schema)
    (got,) = run(spark, running_quantiles(stream, ["v", "same", "none"], (0.5, 0.99, 0.001)), "quantiles", "complete").collect()
    assert got["n_v"] == 30_000 and got["n_none"] == 0 and got["median_none"] == 0 and got["median_same"] == got["q99_same"] == 7
    for p, name in ((0.5, "median_v"), (0.99, "q99_v"), (0.001, "q0_1_v")):
        assert rank_error(v, got[name], p) < 0.0025 and got[name] in v


def test_windowed_medians(spark, tmp_path):
    rng = np.random.default_rng(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=i), float(x)) for i, x in enumerate(rng.normal(size=600))]
    parts = [spark.createDataFrame(part, "ts timestamp, v double") for part in (rows[:300], rows[300:])]
    stream = stream_of(spark, tmp_path, parts, parts[0].schema)
    got = run(spark, windowed_quantiles(stream, "ts", ["v"], "1 hour", "10 minutes"), "windowed", "complete").collect()
    assert len(got) == 10 and all(r["n_v"] == 60 for r in got)
    for i, r in enumerate(sorted(got, key=lambda r: r["window"]["start"])):
        assert rank_error([x for _, x in rows[60 * i : 60 * i + 60]], r["median_v"], 0.5) < 0.01


def test_odd_asks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert running_quantiles(df, ["v"]).first()["median_v"] == 2.0
    assert running_quantiles(df.limit(0), ["v"]).first()["median_v"] == 0.0
    with pytest.raises(ValueError):
        running_quantiles(df, ["v"], (1.5,))
