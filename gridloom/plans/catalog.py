"""The registered queries over the reference tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import elementwise as E
from gridloom.functions import metrics
from gridloom.operators import factor, linalg, tsqr
from gridloom.operators.array import NDArray, correlation
from gridloom.operators.blocks import Vectors
from gridloom.operators.cluster import KMeans
from gridloom.operators.decomposition import PCA
from gridloom.operators.frame import Frame
from gridloom.operators.linear import Lasso, LinearRegression, LogisticRegression, Ridge
from gridloom.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor
from gridloom.operators.optim import Adam, GradientDescent, StochasticGradientDescent
from gridloom.operators.order import with_position
from gridloom.operators.preprocessing import MinMaxScaler, OneHotEncoder, StandardScaler, normalize_rows, polynomial_features
from gridloom.operators.selection import cross_val_linear, cross_val_score, fold, select_k_best, train_test_split
from gridloom.operators.tiles import Tiles
from gridloom.sources import files
from gridloom.sources.scratch import scratch_path, staged
from gridloom.streaming.running import running_quantiles

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, n: int = 4) -> DataFrame:
    """Floating columns rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, n).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = LINES
    f = Frame(table(spark, sf_dir, "lineitem").select(*cols)).filter(F.col("l_discount") > 0.05)
    parts = [f.stat(n, cols).select(*[F.col(c).alias(f"{n}_{c}") for c in cols]) for n in ("mean", "stddev", "median")]
    return rounded(parts[0].join(parts[1]).join(F.broadcast(parts[2])))  # three one-row tables


query(
    "SELECT " + ", ".join(f"round({f}({c}), 4) AS {n}_{c}" for c in LINES for n, f in (("mean", "avg"), ("stddev", "stddev_samp"), ("median", "median"))) + " FROM lineitem WHERE l_discount > 0.05"
)(flagship)


def lines(spark: SparkSession, sf_dir: str) -> Frame:
    return Frame(table(spark, sf_dir, "lineitem"), LINE_KEYS)


def orders(spark: SparkSession, sf_dir: str) -> Frame:
    return Frame(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), ["o_orderkey"])


def parts(spark: SparkSession, sf_dir: str) -> Frame:
    return Frame(table(spark, sf_dir, "part"), ["p_partkey"])


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"

# projection and schema


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_discount > 0.05")
def select_filter(spark, sf_dir):
    return lines(spark, sf_dir).filter(F.col("l_discount") > 0.05).select(["l_orderkey", "l_quantity", "l_discount", "l_quantity"]).df


@query("SELECT p_partkey, round(p_retailprice * p_size, 4) AS worth FROM part")
def add_column(spark, sf_dir):
    return rounded(parts(spark, sf_dir).add_column("worth", F.col("p_retailprice") * F.col("p_size")).select(["p_partkey", "worth"]).df)


@query("SELECT p.p_partkey, coalesce(n, 0) AS n FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def add_column_values(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return parts(spark, sf_dir).select(["p_partkey"]).add_column_values("n", counts, ["p_partkey"]).fill_na(0).df


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def add_row(spark, sf_dir):
    return Frame(table(spark, sf_dir, "region"), ["r_regionkey"]).add_row({"r_regionkey": 99, "r_name": "NOWHERE"}).df


@query("SELECT n_nationkey, n_name FROM nation")
def remove_column(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation"), ["n_nationkey"]).remove_column("n_regionkey").df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 7")
def remove_row(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation"), ["n_nationkey"]).remove_row(7).df


@query("SELECT n_nationkey, n_name AS label, n_regionkey FROM nation")
def rename_column(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation"), ["n_nationkey"]).rename_column("n_name", "label").df


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS p_retailprice FROM part")
def apply_column(spark, sf_dir):
    return rounded(parts(spark, sf_dir).select(["p_partkey", "p_retailprice"]).apply("p_retailprice", E.sqrt).df, 6)


@query("SELECT p_partkey, (p_size * 2)::DOUBLE AS p_size, round(p_retailprice * 2.0, 4) AS p_retailprice FROM part")
def apply_all(spark, sf_dir):
    return rounded(parts(spark, sf_dir).select(["p_partkey", "p_size", "p_retailprice"]).apply_all(lambda c: c.cast("double") * 2.0).df)


# positional subsets and sorting


@query(f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 25")
def head(spark, sf_dir):
    return orders(spark, sf_dir).head(25).df


@query(f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def tail(spark, sf_dir):
    return orders(spark, sf_dir).tail(25).df


@query(f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 100")
def slice_rows(spark, sf_dir):
    return orders(spark, sf_dir).slice(100, 300).df


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos FROM part")
def sort_desc(spark, sf_dir):
    f = parts(spark, sf_dir).select(["p_partkey", "p_retailprice"])
    return with_position(f.df, [F.desc("p_retailprice"), F.asc("p_partkey")], "pos")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 50")
def sort_head(spark, sf_dir):
    return parts(spark, sf_dir).select(["p_partkey", "p_retailprice"]).sort("p_retailprice").limit(50)


# statistics of columns

for _name, _f in (("mean", "avg"), ("median", "median"), ("stddev", "stddev_samp"), ("variance", "var_samp"), ("min", "min"), ("max", "max")):
    query("SELECT " + ", ".join(f"round({_f}({c}), 4) AS {c}" for c in LINES) + " FROM lineitem", f"col_{_name}")(
        lambda spark, sf_dir, n=_name: rounded(lines(spark, sf_dir).stat(n, LINES))
    )

GAPS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


def gappy(spark: SparkSession, sf_dir: str) -> Frame:
    """Events whose value is NaN for every seventh id and NULL for every eleventh."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    return Frame(table(spark, sf_dir, "events").select("event_id", "user_id", v.alias("value")), ["event_id"])


GAPPY = "(SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events)"


@query(f"SELECT round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS stddev, round(var_samp(value), 4) AS variance, min(value) AS min, max(value) AS max FROM {GAPPY}")
def stats_with_gaps(spark, sf_dir):
    from gridloom.functions import stats

    df = gappy(spark, sf_dir).df
    return rounded(df.agg(*[f(stats.present("value")).alias(n) for n, f in stats.STATISTICS.items()]))


@query(f"SELECT event_id, user_id, coalesce(value, -1.0) AS value FROM {GAPPY}")
def fill_na(spark, sf_dir):
    return gappy(spark, sf_dir).fill_na(-1.0).df


@query(f"SELECT * FROM {GAPPY} WHERE value IS NOT NULL")
def drop_na(spark, sf_dir):
    return gappy(spark, sf_dir).drop_na().df


@query(f"SELECT 'event_id' AS \"column\", 0::BIGINT AS missing UNION ALL SELECT 'user_id', 0 UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL) FROM {GAPPY}")
def is_na(spark, sf_dir):
    return gappy(spark, sf_dir).is_na()


@query(
    f"""WITH g AS {GAPPY}, w AS (SELECT event_id, value,
 last_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS x0, last_value(value IGNORE NULLS) OVER b AS y0,
 first_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS x1, first_value(value IGNORE NULLS) OVER a AS y1
 FROM g WINDOW b AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(coalesce(value, y0 + (y1 - y0) * (event_id - x0) / nullif(x1 - x0, 0)), 6) AS value FROM w"""
)
def interpolate(spark, sf_dir):
    return rounded(gappy(spark, sf_dir).interpolate(["value"], "event_id", block=1000).select(["event_id", "value"]).df, 6)


@query(
    "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"
)
def value_counts(spark, sf_dir):
    return orders(spark, sf_dir).value_counts(["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def group_by_agg(spark, sf_dir):
    return rounded(orders(spark, sf_dir).group_by("o_orderpriority", F.sum, ["o_totalprice"]), 2)


@query(
    "SELECT o_orderpriority, " + ", ".join(f"max(CASE WHEN o_orderstatus = '{s}' THEN n END) AS \"{s}\"" for s in "FOP") + " FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"
)
def pivot_table(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return Frame(counts).pivot("o_orderpriority", "o_orderstatus", "n", ["F", "O", "P"])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def unique_rows(spark, sf_dir):
    return orders(spark, sf_dir).select(["o_orderstatus", "o_orderpriority"]).unique().df


@query(f"SELECT {ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def drop_duplicates(spark, sf_dir):
    return orders(spark, sf_dir).drop_duplicates(["o_custkey"]).df


# joins and stacking


def _customers(spark, sf_dir) -> Frame:
    return Frame(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal", "c_nationkey"), ["key"])


def _priced_orders(spark, sf_dir) -> Frame:
    return Frame(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_totalprice").alias("c_acctbal")), ["o_orderkey"])


_L = "(SELECT c_custkey AS key, c_acctbal, c_nationkey FROM customer)"
_R = "(SELECT o_custkey AS key, o_orderkey, o_totalprice AS c_acctbal FROM orders)"
for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(f"SELECT key, l.c_acctbal AS c_acctbal_x, c_nationkey, o_orderkey, r.c_acctbal AS c_acctbal_y FROM {_L} l {_kind} {_R} r USING (key)", f"merge_{_how}")(
        lambda spark, sf_dir, how=_how: _customers(spark, sf_dir).merge(_priced_orders(spark, sf_dir), "key", how).df
    )
for _how, _not in (("left_semi", ""), ("left_anti", "NOT ")):
    query(f"SELECT * FROM {_L} l WHERE {_not}EXISTS (SELECT 1 FROM {_R} r WHERE r.key = l.key)", f"merge_{_how}")(
        lambda spark, sf_dir, how=_how: _customers(spark, sf_dir).merge(_priced_orders(spark, sf_dir), "key", how).df.select("key", "c_acctbal_x" if how == "inner" else F.col("c_acctbal_x").alias("c_acctbal"), "c_nationkey")
    )


@query("SELECT s_suppkey, s_nationkey, n_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def join_left(spark, sf_dir):
    some = Frame(table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name"))
    return Frame(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")).join(some, "s_nationkey", "n_nationkey", "left").df


_UNLIKE = "SELECT s_suppkey, s_nationkey, n_nationkey, n_name FROM supplier {} JOIN (SELECT n_nationkey + 5 AS n_nationkey, n_name FROM nation) ON s_nationkey = n_nationkey"
for _how, _kind in (("inner", ""), ("right", "RIGHT"), ("outer", "FULL")):
    query(_UNLIKE.format(_kind), f"join_{_how}")(lambda spark, sf_dir, how=_how: _unlike(spark, sf_dir, how))
for _how, _not in (("left_semi", ""), ("left_anti", "NOT ")):
    query(f"SELECT s_suppkey, s_nationkey FROM supplier WHERE {_not}EXISTS (SELECT 1 FROM nation WHERE n_nationkey + 5 = s_nationkey)", f"join_{_how}")(lambda spark, sf_dir, how=_how: _unlike(spark, sf_dir, how))


def _unlike(spark, sf_dir, how: str) -> DataFrame:
    """Suppliers and nations under moved keys, so either side has rows without a partner."""
    moved = Frame(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 5).alias("n_nationkey"), "n_name"))
    return Frame(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")).join(moved, "s_nationkey", "n_nationkey", how).df


@query("SELECT r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def concat_rows(spark, sf_dir):
    r = Frame(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))
    return Frame.concat([r, Frame(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))]).df


@query(
    "SELECT n.i AS _rid, n_name, r_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name FROM nation) n FULL JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_name FROM region) r USING (i)"
)
def concat_cols(spark, sf_dir):
    frames = [Frame(table(spark, sf_dir, "nation"), ["n_nationkey"]), Frame(table(spark, sf_dir, "region"), ["r_regionkey"])]
    return Frame.concat(frames, "1").df.select("_rid", "n_name", "r_name")


# scaling and encoding on frames

_MM = "(p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())"


@query(f"SELECT p_partkey, round({_MM}, 6) AS p_retailprice FROM part")
def normalize_columns(spark, sf_dir):
    return rounded(parts(spark, sf_dir).select(["p_partkey", "p_retailprice"]).normalize(["p_retailprice"]).df, 6)


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def standardize_columns(spark, sf_dir):
    return rounded(parts(spark, sf_dir).select(["p_partkey", "p_retailprice"]).standardize(["p_retailprice"]).df, 6)


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT AS \"o_orderstatus_{s}\"" for s in "FOP") + " FROM orders")
def one_hot_frame(spark, sf_dir):
    return orders(spark, sf_dir).select(["o_orderkey", "o_orderstatus"]).one_hot_encode("o_orderstatus").df


@query("SELECT p_partkey, round(p_retailprice / (max(abs(p_retailprice)) OVER ()), 6) AS p_retailprice FROM part")
def normalize_columns_max(spark, sf_dir):
    return rounded(parts(spark, sf_dir).select(["p_partkey", "p_retailprice"]).normalize(["p_retailprice"], "max").df, 6)


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def normalize_columns_zscore(spark, sf_dir):
    return rounded(parts(spark, sf_dir).select(["p_partkey", "p_retailprice"]).normalize(["p_retailprice"], "zscore").df, 6)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4)::DOUBLE AS q25, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS q50, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS q75, max({c})::DOUBLE AS max FROM lineitem" for c in LINES))
def describe(spark, sf_dir):
    return rounded(lines(spark, sf_dir).describe(LINES))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity * l_discount > 2")
def filter_rows(spark, sf_dir):
    f = lines(spark, sf_dir).select(["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]).filter_rows(lambda b: b["l_quantity"].astype(float) * b["l_discount"].astype(float) > 2)
    return f.remove_column("l_discount").df


@query("SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def group_apply(spark, sf_dir):
    return rounded(orders(spark, sf_dir).group_apply("o_orderpriority", lambda v: v.max() - v.min(), ["o_totalprice"]), 2)


# construction, metadata and access


@query("SELECT NULL::DOUBLE AS a, NULL::DOUBLE AS b WHERE false")
def empty_frame(spark, sf_dir):
    return Frame.empty(spark, ["a", "b"]).df


@query("SELECT 0::BIGINT AS rows, 0 AS cols")
def zero_rows(spark, sf_dir):
    f = Frame.empty(spark)
    return spark.createDataFrame([f.shape()], "rows long, cols int")


@query("SELECT * FROM (VALUES (0::BIGINT, 1.5::DOUBLE, 4::DOUBLE), (1, 2.5, 5), (2, -3, 6)) t(_rid, a, b)")
def frame_of_columns(spark, sf_dir):
    return Frame.from_columns(spark, {"a": [1.5, 2.5, -3], "b": [4, 5, 6]}).df


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders")
def column_access(spark, sf_dir):
    f = orders(spark, sf_dir)
    return rounded(f.df.select(f["o_orderkey"], (f["o_totalprice"] * 2).alias("twice")), 2)


@query("SELECT count(*) AS rows, 5 AS cols, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderpriority' AS columns FROM orders")
def frame_shape(spark, sf_dir):
    f = orders(spark, sf_dir)
    return spark.createDataFrame([(*f.shape(), ",".join(f.columns))], "rows long, cols int, columns string")


@query("SELECT 'rows: ' || count(*) || chr(10) || 'columns: 2' || chr(10) || '  r_regionkey: bigint' || chr(10) || '  r_name: string' AS info FROM region")
def frame_info(spark, sf_dir):
    df = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    return spark.createDataFrame([(Frame(df, ["r_regionkey"]).info(),)], "info string")


# sources and sinks: whole tables written and read back


_ROUND = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag"


def _some_columns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_ROUND.split(", "))


@query(f"SELECT {_ROUND} FROM lineitem")
def csv_round_trip(spark, sf_dir):
    df, path = _some_columns(spark, sf_dir), scratch_path(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@query(f"SELECT {_ROUND} FROM lineitem")
def json_round_trip(spark, sf_dir):
    df, path = _some_columns(spark, sf_dir), scratch_path(spark, "json")
    files.write_json(df, path)
    return files.read_json(spark, path, df.schema)


@query(f"SELECT {_ROUND} FROM lineitem")
def parquet_round_trip(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    files.write_parquet(_some_columns(spark, sf_dir), path)
    return files.read_parquet(spark, path)


_CELLS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey, o_custkey, o_totalprice FROM orders"


@query(f"WITH o AS ({_CELLS}) SELECT i AS i0, 0::BIGINT AS i1, o_orderkey::DOUBLE AS v FROM o UNION ALL SELECT i, 1, o_custkey::DOUBLE FROM o UNION ALL SELECT i, 2, round(o_totalprice::DOUBLE, 4) FROM o")
def matrix_file(spark, sf_dir):
    """Orders as lines of numbers, in order, and the array that is read from them."""
    path = scratch_path(spark, "matrix")
    df = table(spark, sf_dir, "orders")
    files.write_matrix(df, ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderkey"], path)
    return cells(files.read_matrix(spark, path))


# arrays: a vector and a square array from nation, a tall one from supplier


def vector(spark, sf_dir) -> NDArray:
    n = table(spark, sf_dir, "nation")
    return NDArray(n.select(F.col("n_nationkey").alias("i0"), ((F.col("n_nationkey") * 5) % 7 + 0.5).cast("double").alias("v")), (25,))


def square(spark, sf_dir) -> NDArray:
    n = table(spark, sf_dir, "nation").select("n_nationkey")  # 25 rows at every scale
    p, q = n.withColumnRenamed("n_nationkey", "i0"), n.withColumnRenamed("n_nationkey", "i1")
    return NDArray(p.crossJoin(q).withColumn("v", ((F.col("i0") * 7 + F.col("i1") * 3 + F.col("i0") * F.col("i1")) % 11 + 1).cast("double")), (25, 25))


def rect(spark, sf_dir) -> NDArray:
    """25 columns and a row for each supplier: it grows with the tables."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    rows = with_position(s, ["s_suppkey"], "i0").select("i0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("i1"))
    return NDArray(rows.withColumn("v", ((F.col("i0") * 7 + F.col("i1") * 3 + F.col("i0") * F.col("i1")) % 11 + 1).cast("double")), (s.count(), 25))


def tall(spark, sf_dir) -> NDArray:
    s = table(spark, sf_dir, "supplier")
    placed = with_position(s.select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_suppkey") % 17).alias("k")), ["s_suppkey"], "row")
    return NDArray.of_columns(placed, "row", ["s_acctbal", "s_nationkey", "k"], s.count())


X = "x AS (SELECT n_nationkey::BIGINT AS i0, ((n_nationkey * 5) % 7 + 0.5)::DOUBLE AS v FROM nation)"
A = "a AS (SELECT p.n_nationkey::BIGINT AS i0, q.n_nationkey::BIGINT AS i1, ((p.n_nationkey * 7 + q.n_nationkey * 3 + p.n_nationkey * q.n_nationkey) % 11 + 1)::DOUBLE AS v FROM nation p, nation q)"
R = "a AS (SELECT p.i AS i0, q.n_nationkey::BIGINT AS i1, ((p.i * 7 + q.n_nationkey * 3 + p.i * q.n_nationkey) % 11 + 1)::DOUBLE AS v FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) p, nation q)"
M = (
    "s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal, s_nationkey, s_suppkey % 17 AS k FROM supplier), "
    "m AS (SELECT i AS i0, 0::BIGINT AS i1, s_acctbal::DOUBLE AS v FROM s UNION ALL SELECT i, 1, s_nationkey::DOUBLE FROM s UNION ALL SELECT i, 2, k::DOUBLE FROM s)"
)


def cells(a: NDArray | DataFrame, n: int = 4) -> DataFrame:
    return rounded(a.df if isinstance(a, NDArray) else a, n)


def array_query(name: str, sql: str | None, make: Callable[[SparkSession, str], NDArray | DataFrame], n: int = 4) -> None:
    query(sql, name)(lambda spark, sf_dir: cells(make(spark, sf_dir), n))


array_query("array_zeros_ones_full", "SELECT i AS i0, 2.5::DOUBLE AS v FROM range(40) t(i)", lambda s, d: NDArray.zeros(s, (40,)) + NDArray.ones(s, (40,)) + NDArray.full(s, (40,), 1.5))
array_query("array_eye", "SELECT i AS i0, j AS i1, (i = j)::INT::DOUBLE AS v FROM range(12) a(i), range(12) b(j)", lambda s, d: NDArray.eye(s, 12))
array_query("array_arange", "SELECT i AS i0, round(5 - i / 2, 4)::DOUBLE AS v FROM range(20) t(i)", lambda s, d: NDArray.arange(s, 5, -5, -0.5))
array_query("array_linspace", "SELECT i AS i0, round(-1 + i * 3.0 / 24, 4) AS v FROM range(25) t(i)", lambda s, d: NDArray.linspace(s, -1, 2, 25))


@query("SELECT 5000::BIGINT AS cells, true AS inside, true AS spread, true AS whole")
def array_random(spark, sf_dir):
    """What can be said of random cells: their number, their ends, an even spread, and whole numbers where asked."""
    real, whole = NDArray.random(spark, (50, 100), -1, 1, seed=3).df, NDArray.random(spark, (50, 100), 1, 6, seed=4, integer=True).df
    a = real.agg(F.count("v").alias("cells"), ((F.min("v") >= -1) & (F.max("v") < 1)).alias("inside"), ((F.abs(F.avg("v")) < 0.1) & (F.abs(F.stddev("v") - 0.577) < 0.05)).alias("spread"))
    b = whole.agg(((F.min("v") == 1) & (F.max("v") == 6) & (F.countDistinct("v") == 6) & (F.max(F.abs(F.col("v") - F.round("v"))) == 0)).alias("whole"))
    return a.join(b)  # two one-row tables


array_query("array_unary", f"WITH {R} SELECT i0, i1, -v AS v FROM a", lambda s, d: +(-rect(s, d)))
array_query("array_copy", f"WITH {A} SELECT i0, i1, v + 1 AS v FROM a", lambda s, d: NDArray(square(s, d).df, (25, 25)).fill(1) + square(s, d))
array_query("array_offsets", f"WITH {R} SELECT i0, i1, i0 * 25 + i1 AS v FROM a", lambda s, d: (lambda a: a.df.select("i0", "i1", a.flat().alias("v")))(rect(s, d)))
query("SELECT 3 AS ndim, count(*) * 50 AS size, count(*) || ',25,2' AS shape, '50,2,1' AS strides, false AS empty, 57::BIGINT AS place FROM nation", "array_shape")(
    lambda s, d: (lambda a: s.createDataFrame([(a.ndim, a.size, ",".join(map(str, a.shape)), ",".join(map(str, a.strides)), a.empty, a.offset((1, 3, 1)))], "ndim int, size long, shape string, strides string, empty boolean, place long"))(NDArray.zeros(s, (table(s, d, "nation").count(), 25, 2)))
)
query(f"WITH {X} SELECT '[' || string_agg(printf('%g', v), ', ' ORDER BY i0) || ']' AS shown FROM x", "array_print")(lambda s, d: s.createDataFrame([(str(vector(s, d)),)], "shown string"))
array_query("array_diag", f"WITH {X} SELECT p.i AS i0, q.i AS i1, coalesce(x.v, 0) AS v FROM range(27) p(i) CROSS JOIN range(27) q(i) LEFT JOIN x ON x.i0 = p.i AND q.i = p.i + 2", lambda s, d: NDArray.diag(vector(s, d), 2))
array_query("array_fill", f"WITH {A} SELECT i0, i1, 7.0::DOUBLE AS v FROM a", lambda s, d: square(s, d).fill(7))
array_query("array_as_type", f"WITH {M} SELECT i0, i1, trunc(v)::INT AS v FROM m", lambda s, d: tall(s, d).as_type("int"))
array_query("array_at", f"WITH {A} SELECT v FROM a WHERE i0 = 3 AND i1 = 20", lambda s, d: square(s, d).slice([(3, 4), (20, 21)]).df.select("v"))
array_query("matrix_of_frame", f"WITH {M} SELECT i0, i1, round(v, 4) AS v FROM m", lambda s, d: Frame(table(s, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey"), (F.col("s_suppkey") % 17).alias("k")), ["s_suppkey"]).to_matrix(["s_acctbal", "s_nationkey", "k"]))
array_query("frame_of_matrix", f"WITH {A} SELECT i0 AS _rid, max(v) FILTER (WHERE i1 = 0) AS a, max(v) FILTER (WHERE i1 = 1) AS b FROM a WHERE i1 < 2 GROUP BY 1", lambda s, d: Frame.from_matrix(square(s, d).slice([(0, 25), (0, 2)]), ["a", "b"]).df)

_PAIR = f"WITH {A}, b AS (SELECT i1 AS i0, i0 AS i1, v FROM a)"
for _op, _f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("/", lambda a, b: a / b)):
    _word = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide"}[_op]
    array_query(f"array_{_word}", f"{_PAIR} SELECT i0, i1, round(a.v {_op} b.v, 6) AS v FROM a JOIN b USING (i0, i1)", lambda s, d, f=_f: f(square(s, d), square(s, d).transpose()), 6)
    array_query(f"array_{_word}_scalar", f"WITH {A} SELECT i0, i1, round(v {_op} 2.5, 6) AS v FROM a", lambda s, d, f=_f: f(square(s, d), 2.5), 6)
array_query("array_scalar_left", f"WITH {R} SELECT i0, i1, round(-(3 - v) + (2 + v) * 0 + 2 * v, 6) AS v FROM a", lambda s, d: -(3 - rect(s, d)) + (2 + rect(s, d)) * 0 + 2 * rect(s, d), 6)
_ELEMENTWISE: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "exp": ("exp(v / 10)", lambda v: E.exp(v / 10)), "log": ("ln(v)", E.log), "sqrt": ("sqrt(v)", E.sqrt), "pow": ("pow(v, 1.5)", lambda v: E.power(v, 1.5)),
    "round": ("round(v / 4)", lambda v: E.round_half_away(v / 4)), "ceil": ("ceil(v / 4)", lambda v: E.ceil(v / 4)), "floor": ("floor(v / 4)", lambda v: E.floor(v / 4)), "abs": ("abs(v - 5)", lambda v: E.absolute(v - 5)),
    "sin": ("sin(v)", E.sin), "cos": ("cos(v)", E.cos), "tan": ("tan(v)", E.tan), "arcsin": ("asin(v / 12)", lambda v: E.arcsin(v / 12)), "arccos": ("acos(v / 12)", lambda v: E.arccos(v / 12)), "arctan": ("atan(v)", E.arctan),
    "sigmoid": ("1 / (1 + exp(-v))", E.sigmoid), "isnan": ("false", E.is_nan), "isinf": ("false", E.is_inf), "isfinite": ("true", E.is_finite),
}
for _name, (_sql, _f) in _ELEMENTWISE.items():
    _shown = _sql if _sql in ("true", "false") else f"round({_sql}, 6)"
    array_query(f"elementwise_{_name}", f"WITH {R} SELECT i0, i1, {_shown} AS v FROM a", lambda s, d, f=_f: rect(s, d).map(f), 6)

for _name, _sql in (("sum", "sum(v)"), ("max", "max(v)"), ("min", "min(v)"), ("mean", "avg(v)"), ("variance", "var_samp(v)"), ("standard_deviation", "stddev_samp(v)"), ("median", "median(v)"), ("any", "bool_or(v <> 0)"), ("all", "bool_and(v <> 0)")):
    _shown = _sql if "bool" in _sql else f"round({_sql}, 4)"
    array_query(f"total_{_name}", f"WITH {M} SELECT {_shown} AS v FROM m", lambda s, d, f=_name: getattr(tall(s, d), f)())
    array_query(f"axis0_{_name}", f"WITH {M} SELECT i1 AS i0, {_shown} AS v FROM m GROUP BY 1", lambda s, d, f=_name: getattr(tall(s, d), f)(0))
    array_query(f"axis1_{_name}", f"WITH {M} SELECT i0, {_shown} AS v FROM m GROUP BY 1", lambda s, d, f=_name: getattr(tall(s, d), f)(1))
array_query("percentile", f"WITH {M} SELECT i1 AS i0, round(quantile_cont(v, 0.3), 4) AS v FROM m GROUP BY 1", lambda s, d: tall(s, d).percentile(30, 0))
array_query("argmax_axis", f"WITH {R} SELECT i0, min(i1) AS v FROM a JOIN (SELECT i0, max(v) AS t FROM a GROUP BY 1) USING (i0) WHERE v = t GROUP BY 1", lambda s, d: rect(s, d).argmax(1))
array_query("argmin_axis", f"WITH {R} SELECT i1 AS i0, min(a.i0) AS v FROM a JOIN (SELECT i1, min(v) AS t FROM a GROUP BY 1) USING (i1) WHERE v = t GROUP BY 1", lambda s, d: rect(s, d).argmin(0))
array_query("argmax_flat", f"WITH {R} SELECT min(i0 * 25 + i1) AS v FROM a WHERE v = (SELECT max(v) FROM a)", lambda s, d: rect(s, d).argmax())
array_query("trace", f"WITH {A} SELECT sum(v) AS v FROM a WHERE i0 = i1", lambda s, d: square(s, d).trace())
array_query(
    "histogram",
    f"WITH {M}, c AS (SELECT v FROM m WHERE i1 = 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM c), h AS (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9)::BIGINT AS i0, count(*) AS n FROM c, e GROUP BY 1) SELECT i AS i0, coalesce(n, 0)::DOUBLE AS v FROM range(10) t(i) LEFT JOIN h ON i = i0",
    lambda s, d: tall(s, d).slice([(0, table(s, d, "supplier").count()), (0, 1)]).histogram(10),
)
array_query("bincount", f"WITH {R} SELECT i AS i0, count(a.v)::DOUBLE AS v FROM range(12) t(i) LEFT JOIN a ON a.v = i GROUP BY 1", lambda s, d: rect(s, d).bincount())
array_query("digitize", f"WITH {R} SELECT i0, i1, ((v >= 2)::INT + (v >= 5)::INT + (v >= 9)::INT)::BIGINT AS v FROM a", lambda s, d: rect(s, d).digitize([2, 5, 9]))
array_query("correlation", f"{_PAIR} SELECT round(corr(a.v, b.v), 6) AS v FROM a JOIN b USING (i0, i1)", lambda s, d: correlation(square(s, d), square(s, d).transpose()), 6)
array_query("covariance", "SELECT i0, i1, round(v, 6) AS v FROM (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS i0, {j}::BIGINT AS i1, covar_samp({LINES[i]}, {LINES[j]}) AS v FROM lineitem" for i in range(4) for j in range(4)) + ")", lambda s, d: linalg.covariance(table(s, d, "lineitem"), LINES), 6)
array_query("array_normalize", f"WITH {R} SELECT i0, i1, round(v / sqrt(sum(v * v) OVER ()), 6) AS v FROM a", lambda s, d: rect(s, d).normalize(), 6)
array_query("array_standardize", f"WITH {R} SELECT i0, i1, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) AS v FROM a", lambda s, d: rect(s, d).standardize(), 6)
array_query("array_broadcast", f"WITH {R}, {X} SELECT a.i0, a.i1, a.v * x.v AS v FROM a JOIN x ON x.i0 = a.i1", lambda s, d: rect(s, d).zip(vector(s, d), lambda a, b: a * b))
query(f"WITH {A}, {X} SELECT true AS reflexive, bool_and(a.v = b.v) AS symmetric, false AS diagonal, true AS square FROM a JOIN a b ON a.i0 = b.i1 AND a.i1 = b.i0", "array_predicates")(
    lambda s, d: (lambda a: s.createDataFrame([(a.equals(a), a.is_symmetric(), a.is_diagonal(), a.is_square())], "reflexive boolean, symmetric boolean, diagonal boolean, square boolean"))(square(s, d))
)

# scans, stencils and sorts

array_query("cumsum", f"WITH {R} SELECT i0, i1, sum(v) OVER (PARTITION BY i1 ORDER BY i0) AS v FROM a", lambda s, d: rect(s, d).cumsum(0))
array_query("cumprod", f"WITH {X} SELECT i0, round(product(v / 3) OVER (ORDER BY i0), 6) AS v FROM x", lambda s, d: (vector(s, d) / 3).cumprod(), 6)
array_query("cumsum_orders", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS v FROM orders", lambda s, d: NDArray(with_position(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "i0").select("i0", F.col("o_totalprice").alias("v")), (table(s, d, "orders").count(),)).cumsum(), 2)
array_query("diff", f"WITH {X} SELECT p.i0, q.v - p.v AS v FROM x p JOIN x q ON q.i0 = p.i0 + 2", lambda s, d: vector(s, d).diff(2))
array_query("gradient", f"WITH {X} SELECT i0, round(CASE WHEN i0 = 0 THEN (lead(v) OVER w - v) / 0.5 WHEN i0 = 24 THEN (v - lag(v) OVER w) / 0.5 ELSE (lead(v) OVER w - lag(v) OVER w) / 1.0 END, 6) AS v FROM x WINDOW w AS (ORDER BY i0)", lambda s, d: vector(s, d).gradient(0.5), 6)
array_query("trapz", f"WITH {R}, w AS (SELECT i0, (v + lead(v) OVER (PARTITION BY i0 ORDER BY i1)) / 2 AS t FROM a) SELECT i0, sum(t) AS v FROM w GROUP BY 1", lambda s, d: rect(s, d).trapz())
array_query("sort_flat", f"WITH {R}, r AS (SELECT row_number() OVER (ORDER BY v, i0, i1) - 1 AS p, v FROM a) SELECT p // 25 AS i0, p % 25 AS i1, v FROM r", lambda s, d: rect(s, d).sort())
array_query("sort_axis0", f"WITH {R} SELECT row_number() OVER (PARTITION BY i1 ORDER BY v, i0) - 1 AS i0, i1, v FROM a", lambda s, d: rect(s, d).sort(0))
array_query("argsort_axis1", f"WITH {R} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, i1 AS v FROM a", lambda s, d: rect(s, d).argsort(1))
array_query("argsort_flat", f"WITH {R} SELECT row_number() OVER (ORDER BY v, i0, i1) - 1 AS i0, i0 * 25 + i1 AS v FROM a", lambda s, d: rect(s, d).argsort())

# reshaping

array_query("reshape", f"WITH {R} SELECT (i0 * 25 + i1) // 5 AS i0, (i0 * 25 + i1) % 5 AS i1, v FROM a", lambda s, d: (lambda a: a.reshape((a.shape[0] * 5, 5)))(rect(s, d)))
array_query("flatten", f"WITH {R} SELECT i0 * 25 + i1 AS i0, v FROM a", lambda s, d: rect(s, d).flatten())
array_query("transpose", f"WITH {M} SELECT i1 AS i0, i0 AS i1, round(v, 4) AS v FROM m", lambda s, d: tall(s, d).transpose())
array_query("swapaxes", f"WITH {R} SELECT i0 AS i1, i1 AS i0, 0::BIGINT AS i2, v FROM a", lambda s, d: rect(s, d).expand_dims(0).swapaxes(0, 2))
array_query("rotate90", f"WITH {M}, n AS (SELECT count(*) AS n FROM s) SELECT i1 AS i0, n - 1 - i0 AS i1, round(v, 4) AS v FROM m, n", lambda s, d: tall(s, d).rotate90())
array_query("flip", f"WITH {A} SELECT 24 - i0 AS i0, 24 - i1 AS i1, v FROM a", lambda s, d: square(s, d).flip().flip(False))
array_query("array_slice", f"WITH {A} SELECT i0 - 2 AS i0, i1 - 10 AS i1, v FROM a WHERE i0 BETWEEN 2 AND 5 AND i1 BETWEEN 10 AND 19", lambda s, d: square(s, d).slice([(2, 6), (10, 20)]))
array_query("concatenate", f"WITH {R} SELECT i0, i1, v FROM a UNION ALL SELECT i0, i1 + 25, v FROM a", lambda s, d: rect(s, d).concatenate(rect(s, d), 1))
array_query("stack", f"WITH {R} SELECT k AS i0, i0 AS i1, i1 AS i2, v FROM a, range(2) t(k)", lambda s, d: rect(s, d).stack(rect(s, d)))
array_query("split", f"WITH {A} SELECT i0 - 20 AS i0, i1, v FROM a WHERE i0 >= 20", lambda s, d: square(s, d).split(5, 0)[4])
array_query("repeat", f"WITH {R} SELECT i0, i1 * 3 + k AS i1, v FROM a, range(3) t(k)", lambda s, d: rect(s, d).repeat(3, 1))
array_query("expand_squeeze", f"WITH {X} SELECT i0, v FROM x", lambda s, d: vector(s, d).expand_dims(0).expand_dims(2).squeeze())
array_query("pad_constant", f"WITH {X} SELECT i AS i0, coalesce(v, -1) AS v FROM range(30) t(i) LEFT JOIN x ON i0 = i - 2", lambda s, d: vector(s, d).pad([(2, 3)], value=-1))
array_query("pad_edge", f"WITH {A} SELECT p.i AS i0, q.i AS i1, v FROM range(28) p(i), range(27) q(i), a WHERE a.i0 = least(greatest(p.i - 1, 0), 24) AND a.i1 = least(greatest(q.i - 2, 0), 24)", lambda s, d: square(s, d).pad([(1, 2), (2, 0)], "edge"))
array_query("optimize_layout", f"WITH {R} SELECT i0, i1, v FROM a", lambda s, d: rect(s, d).optimize_layout())

# linear algebra

array_query("matmul", f"WITH {M} SELECT p.i1 AS i0, q.i1, round(sum(p.v * q.v), 2) AS v FROM m p JOIN m q ON p.i0 = q.i0 GROUP BY 1, 2", lambda s, d: linalg.matmul(tall(s, d).transpose(), tall(s, d)), 2)
_FACTORS = f"""WITH g AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT {i} AS p, {j} AS q, sum({LINES[i]} * {LINES[j]}) AS s FROM lineitem" for i in range(4) for j in range(4))})),
w AS (SELECT k, unnest(range(64)) AS j, unnest(e) AS v FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding::DOUBLE[] AS e FROM embeddings QUALIFY k < 4))"""


@query(f"{_FACTORS} SELECT a.j AS i0, b.j AS i1, round(sum(a.v * s * b.v) / 1e9, 4) AS v FROM g JOIN w a ON a.k = p JOIN w b ON b.k = q GROUP BY 1, 2")
def tiled_products(spark, sf_dir):
    """Line items (rows x 4) times four embeddings (4 x 64), and the Gram matrix of that: two products by tiles."""
    lines_ = with_position(table(spark, sf_dir, "lineitem").select(*LINE_KEYS, *LINES), LINE_KEYS, "row")
    v, names = _whole_vectors(spark, sf_dir)
    few = with_position(v.orderBy("vec_id").limit(4), ["vec_id"], "row")
    wide = Tiles.of_rows(lines_, "row", LINES, lines_.count()).matmul(Tiles.of_rows(few, "row", names, 4))
    return rounded(wide.gram().to_array().df.withColumn("v", F.col("v") / 1e9), 4)


#: A square array that grows with supplier: a diagonal and a product of two columns.
_BORDERED = """s AS (
  SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, (2 + s_suppkey % 11)::DOUBLE AS d, 1 + (s_suppkey % 7) / 7.0::DOUBLE AS u, (1 + s_nationkey) / 100.0::DOUBLE AS v FROM supplier
), t AS (SELECT 1 + sum(u * v / d) AS t FROM s)"""


def bordered(spark, sf_dir) -> DataFrame:
    """(row, x) of that array, made by all cores."""
    s = table(spark, sf_dir, "supplier")
    placed = with_position(s.select("s_suppkey", (2.0 + F.col("s_suppkey") % 11).alias("d"), (1 + (F.col("s_suppkey") % 7) / 7.0).alias("u"), ((1 + F.col("s_nationkey")) / 100.0).alias("v")), ["s_suppkey"], "row")
    across = np.zeros(placed.count())
    for r in placed.select("row", "v").collect():  # one row of the array
        across[r["row"]] = r["v"]
    step = max(1, factor.BATCH // (8 * max(1, len(across))))

    def made(batches):
        for b in batches:
            row, d, u = (b.column(k).to_numpy() for k in range(3))
            for at in range(0, len(row), step):
                x = u[at : at + step, None] * across
                x[np.arange(len(x)), row[at : at + step]] += d[at : at + step]
                offsets = pa.array(np.arange(len(x) + 1) * len(across), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + step], pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["row", "x"])

    return placed.select("row", "d", "u").repartition(2 * spark.sparkContext.defaultParallelism, "row").mapInArrow(made, "row long, x array<double>")


@query(f"WITH {_BORDERED} SELECT a.i AS i0, b.i AS i1, round((a.i = b.i)::INT / a.d - a.u / a.d * b.v / b.d / t, 8) AS v FROM s a, s b, t")
def blocked_inverse(spark, sf_dir):
    """Every cell of the inverse, panels swept out; SQL has it in closed form."""
    return rounded(factor.inverse(bordered(spark, sf_dir)).df, 8)


@query(f"WITH {_BORDERED} SELECT 1 AS sign, round(sum(ln(d)) + ln(any_value(t)), 6) AS log FROM s, t")
def blocked_determinant(spark, sf_dir):
    sign, log = factor.determinant(bordered(spark, sf_dir))
    return spark.createDataFrame([(sign, round(log, 6))], "sign int, log double")


@query(f"WITH {_BORDERED} SELECT a.i AS \"row\", round(sum(a.u * b.v + (a.i = b.i)::INT * a.d), 6) AS total, round(sum(pow(a.u * b.v + (a.i = b.i)::INT * a.d, 2)), 6) AS squares FROM s a, s b GROUP BY 1")
def blocked_lu(spark, sf_dir):
    """Sums and squares of the rows of L U, each under the number of the row that it factors."""
    f = factor.lu(bordered(spark, sf_dir))
    low, up = f.tiles()
    back = low.matmul(up).to_array().df
    named = back.join(f.permutation(), F.col("i0") == F.col("place"))
    sums = rounded(named.groupBy("row").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares")), 6)
    with factor.in_pieces(spark, 0):  # tiles in small batches, too
        return staged(sums, "lu-sums")


_SPREAD = "sqrt((a - c) * (a - c) / 4 + b * b)"


@query(
    "WITH t AS (SELECT sum(p_size * p_size)::DOUBLE AS a, sum(p_size * p_retailprice) AS b, sum(p_retailprice * p_retailprice) AS c FROM part), "
    f"u AS (SELECT (a + c) / 2 + {_SPREAD} AS p, (a * c - b * b) / ((a + c) / 2 + {_SPREAD}) AS q, b, a FROM t), "
    "w AS (SELECT p, q, b / sqrt(b * b + (p - a) * (p - a)) AS x, (p - a) / sqrt(b * b + (p - a) * (p - a)) AS y FROM u) "
    "SELECT p_partkey, round((p_size * x + p_retailprice * y) / sqrt(p), 6) AS u0, round((p_size * y - p_retailprice * x) / sqrt(q), 6) AS u1 FROM part, w"
)
def left_vectors_parts(spark, sf_dir):
    """Left singular vectors of parts' sizes and prices: the triangle of all rows, then one pass."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    u, _, _ = tsqr.svd(df, ["p_size", "p_retailprice"])
    return rounded(u.select("p_partkey", F.col("u")[0].alias("u0"), F.col("u")[1].alias("u1")), 6)


array_query("dot", f"WITH {X} SELECT sum(v * v) AS v FROM x", lambda s, d: linalg.dot(vector(s, d), vector(s, d)))
array_query("convolve_same", f"WITH {A}, k AS (SELECT * FROM (VALUES (0,0,1.0),(0,1,2.0),(1,0,-1.0),(2,2,0.5)) t(p, q, w)) SELECT i0 + p - 1 AS i0, i1 + q - 1 AS i1, sum(v * w)::DOUBLE AS v FROM a, k WHERE i0 + p - 1 BETWEEN 0 AND 24 AND i1 + q - 1 BETWEEN 0 AND 24 GROUP BY 1, 2", lambda s, d: NDArray(linalg.convolve(square(s, d), [[1, 2, 0], [-1, 0, 0], [0, 0, 0.5]], "same").df.where("v is not null"), (25, 25)))
for _mode, _shift, _last in (("full", 0, 26), ("valid", 2, 22)):
    array_query(
        f"convolve_{_mode}",
        f"WITH {A}, k AS (SELECT p, q, (p * 3 + q - 4)::DOUBLE AS w FROM range(3) a(p), range(3) b(q)) SELECT i0 + p - {_shift} AS i0, i1 + q - {_shift} AS i1, sum(v * w) AS v FROM a, k WHERE i0 + p - {_shift} BETWEEN 0 AND {_last} AND i1 + q - {_shift} BETWEEN 0 AND {_last} GROUP BY 1, 2",
        lambda s, d, mode=_mode: linalg.convolve(square(s, d), [[p * 3 + q - 4 for q in range(3)] for p in range(3)], mode),
    )

_C2 = "SELECT var_samp(l_discount) AS a, covar_samp(l_discount, l_tax) AS b, var_samp(l_tax) AS c FROM lineitem"


def _cov2(spark, sf_dir) -> NDArray:
    return NDArray(linalg.covariance(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]), (2, 2)) * 1000


@query(f"WITH t AS ({_C2}) SELECT round((a * c - b * b) * 1e6, 6) AS v FROM t")
def determinant(spark, sf_dir):
    return rounded(spark.createDataFrame([(linalg.determinant(_cov2(spark, sf_dir)),)], "v double"), 6)


@query(f"WITH t AS ({_C2}), d AS (SELECT *, (a * c - b * b) * 1000 AS det FROM t) SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, round(c / det, 4) AS v FROM d UNION ALL SELECT 0, 1, round(-b / det, 4) FROM d UNION ALL SELECT 1, 0, round(-b / det, 4) FROM d UNION ALL SELECT 1, 1, round(a / det, 4) FROM d")
def inverse(spark, sf_dir):
    return cells(linalg.inverse(_cov2(spark, sf_dir)))


@query(f"WITH t AS ({_C2}) SELECT round(1000 * ((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 6) AS first, round(1000 * ((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)), 6) AS second FROM t")
def eigen_values(spark, sf_dir):
    values, _ = linalg.eigen(_cov2(spark, sf_dir))
    return rounded(spark.createDataFrame([tuple(map(float, values))], "first double, second double"), 6)


@query(f"WITH t AS ({_C2}) SELECT round(1000 * ((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 6) AS first, round(abs(b) / sqrt(b * b + pow((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) - a, 2)), 4) AS x, round(abs((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) - a) / sqrt(b * b + pow((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) - a, 2)), 4) AS y FROM t")
def eigen_vector(spark, sf_dir):
    values, vectors = linalg.eigen(_cov2(spark, sf_dir))
    return rounded(rounded(spark.createDataFrame([(float(values[0]), *map(float, abs(vectors[:, 0])))], "first double, x double, y double"), 6).select("first", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")), 6)


_GRAM2 = "SELECT sum(s_acctbal * s_acctbal) AS a, sum(s_acctbal * s_nationkey) AS b, sum(s_nationkey * s_nationkey)::DOUBLE AS c FROM supplier"


@query(f"WITH t AS ({_GRAM2}) SELECT round(sqrt((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 2) AS first, round((a * c - b * b) / ((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 1) AS second_squared, 2 AS rank FROM t")
def svd_values(spark, sf_dir):
    """Singular values of suppliers' balances and nations; a third column that is twice another adds no rank."""
    s = with_position(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_nationkey") * 2).alias("t")), ["s_suppkey"], "row")
    n = s.count()
    _, sigma, _ = linalg.svd(NDArray.of_columns(s, "row", ["s_acctbal", "s_nationkey"], n))
    return spark.createDataFrame([(round(float(sigma[0]), 2), round(float(sigma[1] ** 2), 1), linalg.rank(NDArray.of_columns(s, "row", ["s_acctbal", "s_nationkey", "t"], n)))], "first double, second_squared double, rank int")


@query(f"WITH t AS ({_GRAM2}) SELECT round(b / a, 8) AS low, round(a / 1e6, 4) AS u00, round(b / 1e6, 4) AS u01, round(c - b * b / a, 2) AS u11 FROM t")
def lu_factors(spark, sf_dir):
    """Factors of the Gram matrix of balances and nations, whose first row is the pivot."""
    g = linalg.gram(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"])[1:, 1:]
    low, up, _ = (linalg.to_numpy(x) for x in linalg.lu(linalg.from_numpy(spark, g)))
    return spark.createDataFrame([(round(float(low[1, 0]), 8), round(float(up[0, 0] / 1e6), 4), round(float(up[0, 1] / 1e6), 4), round(float(up[1, 1]), 2))], "low double, u00 double, u01 double, u11 double")


@query("SELECT 25 AS rank, true AS lu, true AS svd")
def lu_svd_rank(spark, sf_dir):
    a = square(spark, sf_dir) + NDArray.eye(spark, 25) * 30
    low, up, p = linalg.lu(a)
    u, sigma, vt = linalg.svd(a)
    u, vt, x = (linalg.to_numpy(m) for m in (u, vt, a))
    off = float(np.abs(linalg.to_numpy(low) @ linalg.to_numpy(up) - linalg.to_numpy(p) @ x).max())
    return spark.createDataFrame([(linalg.rank(a), bool(off < 1e-9), bool(np.abs(u * sigma @ vt - x).max() < 1e-9))], "rank int, lu boolean, svd boolean")


# preprocessing


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def standard_scaler(spark, sf_dir):
    return rounded(StandardScaler(["p_size", "p_retailprice"]).fit_transform(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")), 6)


@query("SELECT p_partkey, round(p_size::DOUBLE, 6) AS p_size FROM part")
def standard_scaler_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    s = StandardScaler(["p_size"]).fit(df)
    return rounded(s.inverse_transform(s.transform(df)), 6)


@query("SELECT p_partkey, round(-1 + 2 * (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS p_size FROM part")
def minmax_scaler(spark, sf_dir):
    return rounded(MinMaxScaler(["p_size"], -1, 1).fit_transform(table(spark, sf_dir, "part").select("p_partkey", "p_size")), 6)


@query("SELECT p_partkey, round(p_size::DOUBLE, 6) AS p_size FROM part")
def minmax_scaler_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    s = MinMaxScaler(["p_size"]).fit(df)
    return rounded(s.inverse_transform(s.transform(df)), 6)


for _norm, _sql in (("l1", "(abs(p_size) + abs(p_retailprice))"), ("l2", "sqrt(p_size * p_size + p_retailprice * p_retailprice)"), ("max", "greatest(abs(p_size), abs(p_retailprice))")):
    query(f"SELECT p_partkey, round(p_size / {_sql}, 6) AS p_size, round(p_retailprice / {_sql}, 6) AS p_retailprice FROM part", f"normalize_rows_{_norm}")(
        lambda spark, sf_dir, n=_norm: rounded(normalize_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], n), 6)
    )


@query("SELECT n_nationkey, " + ", ".join(f"(n_regionkey = {k})::INT::DOUBLE AS n_regionkey_{k}" for k in range(5)) + " FROM nation")
def one_hot_encoder(spark, sf_dir):
    return OneHotEncoder(["n_regionkey"]).fit_transform(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))


@query("SELECT n_nationkey, n_regionkey FROM nation")
def one_hot_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    e = OneHotEncoder(["n_regionkey"]).fit(df)
    return e.inverse_transform(e.transform(df))


@query("SELECT p_partkey, 1.0::DOUBLE AS \"1\", p_size::DOUBLE AS \"s\", round(p_retailprice, 4) AS \"r\", (p_size * p_size)::DOUBLE AS \"s*s\", round(p_size * p_retailprice, 4) AS \"s*r\", round(p_retailprice * p_retailprice, 4) AS \"r*r\" FROM part")
def poly_features(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    return rounded(polynomial_features(df, ["s", "r"]))


# models

_X1, _Y1 = "l_quantity", "l_extendedprice"


def _fitted(spark, model) -> DataFrame:
    return rounded(spark.createDataFrame([(float(model.intercept), float(model.coef[0]))], "intercept double, coef double"))


@query(f"SELECT round(regr_intercept({_Y1}, {_X1}), 4) AS intercept, round(regr_slope({_Y1}, {_X1}), 4) AS coef FROM lineitem")
def ols_1d(spark, sf_dir):
    return _fitted(spark, LinearRegression([_X1], _Y1).fit(table(spark, sf_dir, "lineitem")))


@query(f"SELECT round(regr_r2({_Y1}, {_X1}), 6) AS v FROM lineitem")
def ols_score(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return rounded(LinearRegression([_X1], _Y1).fit(df).score(df), 6)


_MOMENTS = f"SELECT count(*) AS n, avg({_X1}) AS mx, avg({_Y1}) AS my, sum({_X1} * {_X1}) AS sxx, sum({_X1} * {_Y1}) AS sxy, sum({_X1}) AS sx FROM lineitem"


@query(f"WITH t AS ({_MOMENTS}), w AS (SELECT *, (sxy - n * mx * my) / (sxx - n * mx * mx + 50) AS w FROM t) SELECT round(my - w * mx, 4) AS intercept, round(w, 4) AS coef FROM w")
def ridge_1d(spark, sf_dir):
    return _fitted(spark, Ridge([_X1], _Y1, alpha=50.0).fit(table(spark, sf_dir, "lineitem")))


@query(f"WITH t AS ({_MOMENTS}), r AS (SELECT *, (sxy - my * sx) / n AS r FROM t) SELECT round(my, 4) AS intercept, round(sign(r) * greatest(abs(r) - 100, 0) / (sxx / n), 4) AS coef FROM r")
def lasso_1d(spark, sf_dir):
    return _fitted(spark, Lasso([_X1], _Y1, alpha=100.0, tol=1e-9).fit(table(spark, sf_dir, "lineitem")))


_TWO = f"SELECT count(*) AS n, avg({_X1}) AS m1, avg(l_discount) AS m2, avg({_Y1}) AS my, covar_pop({_X1}, {_X1}) * count(*) AS a, covar_pop({_X1}, l_discount) * count(*) AS b, covar_pop(l_discount, l_discount) * count(*) AS c, covar_pop({_X1}, {_Y1}) * count(*) AS p, covar_pop(l_discount, {_Y1}) * count(*) AS q FROM lineitem"


def _solved(alpha: float) -> str:
    """The closed solution of two centred columns."""
    d = f"((a + {alpha}) * (c + {alpha}) - b * b)"
    return f"WITH t AS ({_TWO}), w AS (SELECT *, (p * (c + {alpha}) - q * b) / {d} AS w1, (q * (a + {alpha}) - p * b) / {d} AS w2 FROM t) SELECT my - w1 * m1 - w2 * m2 AS intercept, w1, w2 FROM w"


def _two(model, df) -> tuple:
    m = model.fit(df)
    return float(m.intercept), *map(float, m.coef)


_PAIRED = [_X1, "l_discount"]
for _name, _alpha, _model in (("ols", 0.0, lambda: LinearRegression(_PAIRED, _Y1)), ("ridge", 10.0, lambda: Ridge(_PAIRED, _Y1, alpha=10.0))):
    query(f"SELECT round(intercept, 2) AS intercept, round(w1, 3) AS w1, round(w2, 2) AS w2 FROM ({_solved(_alpha)})", f"{_name}_multi")(
        lambda spark, sf_dir, model=_model: (lambda got: spark.createDataFrame([(round(got[0], 2), round(got[1], 3), round(got[2], 2))], "intercept double, w1 double, w2 double"))(_two(model(), table(spark, sf_dir, "lineitem")))
    )
_RAW2 = f"SELECT count(*) AS n, avg({_Y1}) AS my, sum({_X1} * {_X1}) AS a, sum({_X1} * l_discount) AS b, sum(l_discount * l_discount) AS c, sum({_X1} * {_Y1}) - avg({_Y1}) * sum({_X1}) AS p, sum(l_discount * {_Y1}) - avg({_Y1}) * sum(l_discount) AS q FROM lineitem"


@query(
    f"WITH RECURSIVE t AS ({_RAW2}), r AS (SELECT 0 AS k, 0::DOUBLE AS w1, 0::DOUBLE AS w2 UNION ALL SELECT k + 1, u1, sign((q - b * u1) / n) * greatest(abs((q - b * u1) / n) - 10, 0) / (c / n) FROM (SELECT *, sign((p - b * w2) / n) * greatest(abs((p - b * w2) / n) - 10, 0) / (a / n) AS u1 FROM r, t) WHERE k < 400) "
    "SELECT round(my, 2) AS intercept, round(w1, 3) AS w1, round(w2, 2) AS w2 FROM r, t WHERE k = 400"
)
def lasso_multi(spark, sf_dir):
    got = _two(Lasso(_PAIRED, _Y1, alpha=10.0, tol=1e-10), table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(round(got[0], 2), round(got[1], 3), round(got[2], 2))], "intercept double, w1 double, w2 double")


_PREDICTED = f"SELECT l_orderkey, l_linenumber, {_Y1} AS y, {{intercept}} + {{slope}} * {_X1} AS p FROM lineitem, w"
_RIDGE_W = f"WITH t AS ({_MOMENTS}), w AS (SELECT (sxy - n * mx * my) / (sxx - n * mx * mx + 50) AS w, my - (sxy - n * mx * my) / (sxx - n * mx * mx + 50) * mx AS b FROM t)"
_LASSO_W = f"WITH t AS ({_MOMENTS}), w AS (SELECT my AS b, sign((sxy - my * sx) / n) * greatest(abs((sxy - my * sx) / n) - 100, 0) / (sxx / n) AS w FROM t)"
for _name, _with, _model in (("ridge", _RIDGE_W, lambda: Ridge([_X1], _Y1, alpha=50.0)), ("lasso", _LASSO_W, lambda: Lasso([_X1], _Y1, alpha=100.0, tol=1e-9))):
    _rows = _PREDICTED.format(intercept="b", slope="w")
    query(f"{_with} SELECT l_orderkey, l_linenumber, round(p, 3) AS prediction FROM ({_rows})", f"{_name}_predict")(
        lambda spark, sf_dir, model=_model: (lambda df: rounded(model().fit(df).predict(df).select("l_orderkey", "l_linenumber", "prediction"), 3))(table(spark, sf_dir, "lineitem"))
    )
    query(f"{_with} SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS v FROM ({_rows})", f"{_name}_score")(
        lambda spark, sf_dir, model=_model: (lambda df: rounded(model().fit(df).score(df), 6))(table(spark, sf_dir, "lineitem"))
    )


def _toxic_lengths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("x")).join(table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT round(-0.1 * avg(0.5 - toxic), 6) AS intercept, round(-0.1 * avg((0.5 - toxic) * n_chars / 1000), 6) AS coef FROM documents JOIN labels USING (doc_id)")
def logistic_step(spark, sf_dir):
    m = LogisticRegression(["x"], "toxic", lr=0.1, max_iter=1).fit(_toxic_lengths(spark, sf_dir))
    return rounded(spark.createDataFrame([(float(m.intercept), float(m.coef[0]))], "intercept double, coef double"), 6)


def _descent(rounds: int) -> str:
    """Rounds of gradient descent, one table of weights each."""
    out = ["x AS MATERIALIZED (SELECT doc_id, n_chars / 1000 AS x, toxic::DOUBLE AS y FROM documents JOIN labels USING (doc_id))", "w0 AS (SELECT 0::DOUBLE AS b, 0::DOUBLE AS w)"]
    for k in range(rounds):
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT any_value(b) - 0.1 * avg(1 / (1 + exp(-(b + w * x))) - y) AS b, any_value(w) - 0.1 * avg((1 / (1 + exp(-(b + w * x))) - y) * x) AS w FROM x, w{k})")
    return "WITH " + ", ".join(out)


_PROBABILITY = "1 / (1 + exp(-(b + w * x)))"


@query(f"{_descent(8)} SELECT round(avg(((CASE WHEN {_PROBABILITY} >= 0.5 THEN 1 ELSE 0 END) = y)::INT), 6) AS v FROM x, w8")
def logistic_score(spark, sf_dir):
    df = _toxic_lengths(spark, sf_dir)
    return rounded(LogisticRegression(["x"], "toxic", lr=0.1, max_iter=8).fit(df).score(df), 6)


@query(f"{_descent(8)} SELECT doc_id, round({_PROBABILITY}, 6) AS probability, (CASE WHEN {_PROBABILITY} >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS prediction FROM x, w8")
def logistic_predict(spark, sf_dir):
    df = _toxic_lengths(spark, sf_dir)
    m = LogisticRegression(["x"], "toxic", lr=0.1, max_iter=8).fit(df)
    return rounded(m.predict(m.predict_proba(df)).select("doc_id", "probability", "prediction"), 6)


def _whole_vectors(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """(vec_id, label, a column for each component), and the components' names."""
    df = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(df.agg(F.max(F.size("embedding"))).first()[0])]
    return df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(e) for i, e in enumerate(names)]), names


def _vectors(spark, sf_dir) -> tuple[DataFrame, Vectors]:
    """(vec_id, label, embedding), and the embeddings as vectors."""
    df = table(spark, sf_dir, "embeddings")
    return df, Vectors("embedding", df.select(F.size("embedding")).first()[0])


#: Components of an embedding, and three centres over all of them.
_WIDTH = 64
_CENTERS = [[((7 * k + 3 * i) % 11 - 5) / 25 for i in range(_WIDTH)] for k in range(3)]
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_C0 = "c0(k, c) AS (VALUES " + ", ".join(f"({k}, {[float(x) for x in c]}::DOUBLE[])" for k, c in enumerate(_CENTERS)) + ")"


def _lloyd(rounds: int) -> str:
    """Rounds of k-means over whole vectors: assignments a1, a2 .. and centres c1, c2 .."""
    out = [_V, _C0]
    for r in range(1, rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, arg_min(k, list_distance(e, c))::INT AS k, min(list_distance(e, c)) AS d FROM v, c{r - 1} GROUP BY vec_id)")
        means = f"SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(e[i]) AS m FROM a{r}, range(1, {_WIDTH + 1}) t(i) GROUP BY 1, 2) GROUP BY 1"
        out.append(f"c{r} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r - 1} o LEFT JOIN ({means}) m USING (k))")
    return "WITH " + ", ".join(out)


@query(f"{_lloyd(1)} SELECT vec_id, k AS prediction FROM a1")
def kmeans_assign(spark, sf_dir):
    df, names = _vectors(spark, sf_dir)
    return KMeans(names, 3, centers=np.array(_CENTERS)).predict(df).select("vec_id", "prediction")


@query(f"{_lloyd(1)} SELECT k::INT AS cluster, i::INT AS component, round(c[i + 1], 6) AS v FROM c1, range({_WIDTH}) t(i)")
def kmeans_step(spark, sf_dir):
    df, names = _vectors(spark, sf_dir)
    m = KMeans(names, 3, max_iter=1).fit(df, _CENTERS)
    return rounded(spark.createDataFrame([(k, i, float(x)) for k, c in enumerate(m.centers) for i, x in enumerate(c)], "cluster int, component int, v double"), 6)


@query(f"{_lloyd(1)} SELECT round(sum(d * d), 4) AS v FROM a1")
def kmeans_inertia(spark, sf_dir):
    df, names = _vectors(spark, sf_dir)
    return rounded(KMeans(names, 3, centers=np.array(_CENTERS)).inertia(df))


@query(f"{_lloyd(7)} SELECT vec_id, k AS prediction FROM a7")
def kmeans_fit(spark, sf_dir):
    """Six rounds from given centres, then the assignment to the last ones."""
    df, names = _vectors(spark, sf_dir)
    return KMeans(names, 3, max_iter=6, tol=0.0).fit(df, _CENTERS).predict(df).select("vec_id", "prediction")


@query()
def kmeans_seeded(spark, sf_dir):
    df, names = _vectors(spark, sf_dir)
    return KMeans(names, 3, max_iter=10).fit_predict(df).select("vec_id", "prediction")


def _axis(n: str, cov: str, squarings: int = 26) -> str:
    """x{n}(i, v): the leading unit eigenvector of a covariance table, its largest entry positive, by squaring the matrix over and over."""
    out = [f"p{n}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sqrt(sum(v * v)) FROM {cov}) AS v FROM {cov})"]
    for r in range(squarings):
        out.append(f"q{n}{r} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{n}{r} a JOIN p{n}{r} b ON a.j = b.i GROUP BY 1, 2)")
        out.append(f"p{n}{r + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sqrt(sum(v * v)) FROM q{n}{r}) AS v FROM q{n}{r})")
    last = f"p{n}{squarings}"
    out.append(f"x{n} AS MATERIALIZED (SELECT i, v / sqrt((SELECT v FROM {last} WHERE i = k AND j = k)) AS v FROM {last}, (SELECT arg_max(i, v) AS k FROM {last} WHERE i = j) WHERE j = k)")
    return ", ".join(out)


_PCA = f"""WITH {_V}, e AS MATERIALIZED (SELECT vec_id, unnest(range({_WIDTH})) AS i, unnest(e) AS v FROM v),
z AS MATERIALIZED (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM e),
c0m AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS v FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2), {_axis("a", "c0m")},
l0 AS (SELECT sum(x.v * c.v * y.v) AS v FROM c0m c JOIN xa x ON x.i = c.i JOIN xa y ON y.i = c.j),
c1m AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT v FROM l0) * x.v * y.v AS v FROM c0m c JOIN xa x ON x.i = c.i JOIN xa y ON y.i = c.j), {_axis("b", "c1m")}
SELECT vec_id, round(sum(z.v * xa.v), 6) AS pc0, round(sum(z.v * xb.v), 6) AS pc1 FROM z JOIN xa USING (i) JOIN xb USING (i) GROUP BY vec_id"""


_LEADING = f"""WITH {_V}, e AS MATERIALIZED (SELECT vec_id, unnest(range({_WIDTH})) AS i, unnest(e) AS v FROM v),
c0m AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2), {_axis("a", "c0m")},
l0 AS (SELECT sum(x.v * c.v * y.v) AS v FROM c0m c JOIN xa x ON x.i = c.i JOIN xa y ON y.i = c.j),
c1m AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT v FROM l0) * x.v * y.v AS v FROM c0m c JOIN xa x ON x.i = c.i JOIN xa y ON y.i = c.j), {_axis("b", "c1m")},
l1 AS (SELECT sum(x.v * c.v * y.v) AS v FROM c0m c JOIN xb x ON x.i = c.i JOIN xb y ON y.i = c.j)
SELECT 0 AS place, round(v, 5) AS value, true AS exact FROM l0 UNION ALL SELECT 1, round(v, 5), true FROM l1"""


@query(_LEADING)
def leading_eigen(spark, sf_dir):
    """The two largest eigenvalues of the array of all inner products of embeddings, as large as their number squared and never made."""
    df, vectors = _vectors(spark, sf_dir)
    values, _, residuals = factor.leading_eigen_product(df, vectors, 2)
    return spark.createDataFrame([(k, round(float(v), 5), bool(r < 1e-8 * values[0])) for k, (v, r) in enumerate(zip(values, residuals, strict=True))], "place int, value double, exact boolean")


@query(_PCA)
def pca(spark, sf_dir):
    df, names = _vectors(spark, sf_dir)
    return rounded(PCA(names, 2).fit_transform(df).select("vec_id", "pc0", "pc1"), 6)


_AXIS = "(a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)"


@query(
    f"WITH t AS (SELECT var_samp(p_size) AS a, covar_samp(p_size, p_retailprice) AS b, var_samp(p_retailprice) AS c, avg(p_size) AS mx, avg(p_retailprice) AS my FROM part), u AS (SELECT *, b / sqrt(b * b + pow({_AXIS} - a, 2)) AS x, ({_AXIS} - a) / sqrt(b * b + pow({_AXIS} - a, 2)) AS y FROM t) "
    "SELECT p_partkey, round(abs((p_size - mx) * x + (p_retailprice - my) * y), 4) AS pc0, round(abs((p_size - mx) * y - (p_retailprice - my) * x), 4) AS pc1 FROM part, u"
)
def pca_parts(spark, sf_dir):
    """Sizes and prices of parts along their principal axes, whose signs are free."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(PCA(["p_size", "p_retailprice"], 2).fit_transform(df).select("p_partkey", F.abs("pc0").alias("pc0"), F.abs("pc1").alias("pc1")))


_NEAR = f"WITH {_V}, n AS (SELECT q.vec_id AS q, t.label AS y, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, t.e), t.vec_id) AS r FROM v q, v t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0)"


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame, Vectors]:
    """Every fifth vector is asked for, all others are learned from."""
    v, names = _vectors(spark, sf_dir)
    return v.where(F.col("vec_id") % 5 != 0), v.where(F.col("vec_id") % 5 == 0), names


@query(f"{_NEAR}, c AS (SELECT q, y, count(*) AS n FROM n WHERE r <= 5 GROUP BY 1, 2) SELECT q AS vec_id, y AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, y) AS k FROM c) WHERE k = 1")
def knn_classify(spark, sf_dir):
    train, test, names = _halves(spark, sf_dir)
    return KNeighborsClassifier(names, "label", "vec_id").fit(train).predict(test).select("vec_id", "prediction")


@query(f"{_NEAR} SELECT q AS vec_id, round(avg(y), 6) AS prediction FROM n WHERE r <= 5 GROUP BY 1")
def knn_regress(spark, sf_dir):
    train, test, names = _halves(spark, sf_dir)
    return rounded(KNeighborsRegressor(names, "label", "vec_id").fit(train).predict(test).select("vec_id", "prediction"), 6)


# metrics

_YP = "SELECT l_extendedprice AS y, 1000 * l_quantity AS p FROM lineitem"
for _name, _sql, _f in (("mse", "avg((y - p) * (y - p))", metrics.mse), ("rmse", "sqrt(avg((y - p) * (y - p)))", metrics.rmse), ("mae", "avg(abs(y - p))", metrics.mae), ("r2", "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", metrics.r2)):
    query(f"SELECT round({_sql}, 4) AS v FROM ({_YP})", f"metric_{_name}")(
        lambda spark, sf_dir, f=_f: rounded(table(spark, sf_dir, "lineitem").agg(f(F.col("l_extendedprice"), 1000 * F.col("l_quantity")).alias("v")))
    )
_HIT, _P, _Y = "count(*) FILTER (WHERE quality = 1 AND toxic = 1)", "count(*) FILTER (WHERE toxic = 1)", "count(*) FILTER (WHERE quality = 1)"
for _name, _sql, _f in (("accuracy", "avg((quality = toxic)::INT)", metrics.accuracy), ("precision", f"{_HIT} / {_P}", metrics.precision), ("recall", f"{_HIT} / {_Y}", metrics.recall), ("f1", f"2 * {_HIT} / ({_P} + {_Y})", metrics.f1)):
    query(f"SELECT round({_sql}, 6) AS v FROM labels", f"metric_{_name}")(lambda spark, sf_dir, f=_f: rounded(table(spark, sf_dir, "labels").agg(f(F.col("quality"), F.col("toxic")).alias("v")), 6))


@query("SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM c GROUP BY a)) AS i, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM c GROUP BY b)) AS j, (SELECT sum(n) FROM c) AS n) "
    "SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS v FROM s"
)
def adjusted_rand(spark, sf_dir):
    return rounded(metrics.adjusted_rand(table(spark, sf_dir, "labels"), "quality", "toxic"), 6)


@query(
    f"WITH {_V}, d AS (SELECT p.vec_id, p.label AS own, q.label AS other, sum(pow(list_distance(p.e, q.e), 2)) AS s, count(*) AS n FROM v p, v q GROUP BY 1, 2, 3), "
    "m AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1) "
    "SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS v FROM m"
)
def silhouette(spark, sf_dir):
    df, names = _vectors(spark, sf_dir)
    return rounded(metrics.silhouette(df, names, "label"), 6)


# model selection and optimisers


@query("SELECT p_partkey, (p_partkey % 5)::INT AS fold FROM part")
def cv_folds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fold("p_partkey", 5).alias("fold"))


@query("SELECT p_partkey, CASE WHEN ('0x' || md5('1:' || p_partkey)[1:8])::BIGINT / 4294967296.0 < 0.25 THEN 'test' ELSE 'train' END AS part FROM part")
def train_test_parts(spark, sf_dir):
    train, test = train_test_split(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 0.25, seed=1)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


_FOLDED = f"SELECT l_orderkey % 3 AS f, {_X1} AS x, {_Y1} AS y FROM lineitem"


_CROSSED = (
    f"WITH d AS ({_FOLDED}), w AS (SELECT k, regr_slope(y, x) AS w, regr_intercept(y, x) AS b, regr_r2(y, x) AS train FROM d, range(3) t(k) WHERE f <> k GROUP BY 1) "
    "SELECT k::INT AS fold, round(any_value(train), 6) AS train, round(1 - sum((y - b - w * x) * (y - b - w * x)) / (var_pop(y) * count(*)), 6) AS test FROM w JOIN d ON f = k GROUP BY 1"
)


@query(_CROSSED)
def cross_validation(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", _X1, _Y1)
    got = cross_val_score(lambda t: LinearRegression([_X1], _Y1).fit(t), lambda m, t: m.score(t).first()["v"], df, "l_orderkey", 3)
    return rounded(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(got["train_scores"], got["test_scores"], strict=True))], "fold int, train double, test double"), 6)


@query(_CROSSED)
def cross_validation_sums(spark, sf_dir):
    """The same scores from one scan that sums by fold."""
    got = cross_val_linear(table(spark, sf_dir, "lineitem"), [_X1], _Y1, "l_orderkey", 3)
    return rounded(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(got["train_scores"], got["test_scores"], strict=True))], "fold int, train double, test double"), 6)


@query("SELECT feature, round(score, 6) AS score FROM (SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS score FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem) ORDER BY score DESC LIMIT 2")
def select_k_best_features(spark, sf_dir):
    return rounded(select_k_best(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], _Y1, 2).select("feature", "score"), 6)


_MEANS = "m AS (SELECT avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem)"
_PASSES = "p0 AS (SELECT 0::DOUBLE AS x, 0::DOUBLE AS y)" + "".join(
    f", p{k + 1} AS MATERIALIZED (SELECT any_value(p.x) - 0.4 * (any_value(p.x) - avg(l_discount)) AS x, any_value(p.y) - 0.4 * (any_value(p.y) - avg(l_tax)) AS y FROM p{k} p, lineitem WHERE l_orderkey % 4 = {k % 4})" for k in range(12)
)


@query(f"WITH {_MEANS}, {_PASSES} SELECT 'gradient_descent' AS optimizer, round(x, 3) AS x, round(y, 3) AS y FROM m UNION ALL SELECT 'adam', round(x, 3), round(y, 3) FROM m UNION ALL SELECT 'sgd', round(x, 3), round(y, 3) FROM p12")
def optimizers(spark, sf_dir):
    """Minimise the squared distance to the mean discount and tax with each optimiser."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_tax")
    mean = np.array(df.agg(F.avg("l_discount"), F.avg("l_tax")).first(), float)

    def gradient(x: np.ndarray) -> np.ndarray:
        return 2 * (x - mean)

    def batch(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 2 * (x - rows.mean(axis=0))

    cost = lambda x: float(((x - mean) ** 2).sum())
    got = {
        "gradient_descent": GradientDescent(lr=0.1).minimize(cost, gradient, [0, 0]),
        "adam": Adam(lr=0.01, max_iter=500).minimize(cost, gradient, [0, 0]),
        "sgd": StochasticGradientDescent(lr=0.2, max_iter=3, batch_size=-(-df.count() // 4)).minimize(df, "l_orderkey", ["l_discount", "l_tax"], batch, [0, 0]),
    }
    return rounded(spark.createDataFrame([(n, float(x[0]), float(x[1])) for n, x in got.items()], "optimizer string, x double, y double"), 3)


#: Averages of a line x of quantities (in fifties) and prices y (in ten thousands), and steps of two minimisers of mean((p + q x - y)^2).
_LINE = "s AS (SELECT avg(l_quantity / 50) AS x, avg(l_quantity * l_quantity / 2500) AS xx, avg(l_extendedprice / 1e4) AS y, avg(l_quantity * l_extendedprice / 5e5) AS xy FROM lineitem)"
_SLOPES = "2 * (p + q * x - y) AS g, 2 * (p * x + q * xx - xy) AS h"


@query(
    f"WITH RECURSIVE {_LINE}, d AS (SELECT 0 AS r, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q UNION ALL SELECT r + 1, p - 0.2 * g, q - 0.2 * h FROM (SELECT r, p, q, {_SLOPES} FROM d, s WHERE r < 6)), "
    "a AS (SELECT 0 AS r, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS mp, 0.0::DOUBLE AS mq, 0.0::DOUBLE AS vp, 0.0::DOUBLE AS vq UNION ALL "
    "SELECT r, p - 0.3 * mp / (1 - pow(0.9, r)) / (sqrt(vp / (1 - pow(0.999, r))) + 1e-8), q - 0.3 * mq / (1 - pow(0.9, r)) / (sqrt(vq / (1 - pow(0.999, r))) + 1e-8), mp, mq, vp, vq FROM ("
    f"SELECT r + 1 AS r, p, q, 0.9 * mp + 0.1 * g AS mp, 0.9 * mq + 0.1 * h AS mq, 0.999 * vp + 0.001 * g * g AS vp, 0.999 * vq + 0.001 * h * h AS vq FROM (SELECT *, {_SLOPES} FROM a, s WHERE r < 6))) "
    "SELECT 'gradient_descent' AS optimizer, round(p, 6) AS p, round(q, 6) AS q FROM d WHERE r = 6 UNION ALL SELECT 'adam', round(p, 6), round(q, 6) FROM a WHERE r = 6"
)
def descents_on_lines(spark, sf_dir):
    """Six steps of gradient descent and of Adam on a line through all line items; every step's gradient is one pass over them."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1e4).alias("y"))

    def gradient(at: np.ndarray) -> np.ndarray:
        off = float(at[0]) + float(at[1]) * F.col("x") - F.col("y")
        return np.array(df.agg(2 * F.avg(off), 2 * F.avg(off * F.col("x"))).first(), float)

    cost = lambda at: float(df.agg(F.avg((float(at[0]) + float(at[1]) * F.col("x") - F.col("y")) ** 2)).first()[0])
    got = {"gradient_descent": GradientDescent(lr=0.2, max_iter=6, tol=0.0), "adam": Adam(lr=0.3, max_iter=6, tol=0.0)}
    return rounded(spark.createDataFrame([(n, *map(float, m.minimize(cost, gradient, [0, 0]))) for n, m in got.items()], "optimizer string, p double, q double"), 6)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', 0.1::DOUBLE, true), ('{c}', 0.5, true), ('{c}', 0.9, true)" for c in LINES) + ") t(feature, asked, near)")
def sketched_quantiles(spark, sf_dir):
    """Quantiles of line items by the sketches that streams keep: whether each has a rank within half a per cent of the one asked for."""
    df = table(spark, sf_dir, "lineitem").select(*LINES)
    at = (0.1, 0.5, 0.9)
    got = running_quantiles(df, LINES, at).first()
    asked = [(c, p, got[f"median_{c}" if p == 0.5 else f"q{100 * p:g}_{c}"]) for c in LINES for p in at]
    ranks = df.agg(*[f for i, (c, _, v) in enumerate(asked) for f in (F.avg((F.col(c) < v).cast("int")).alias(f"low{i}"), F.avg((F.col(c) <= v).cast("int")).alias(f"high{i}"))]).first()
    return spark.createDataFrame([(c, p, bool(ranks[f"low{i}"] - 0.005 <= p <= ranks[f"high{i}"] + 0.005)) for i, (c, p, _) in enumerate(asked)], "feature string, asked double, near boolean")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
