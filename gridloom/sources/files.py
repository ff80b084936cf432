"""File sources and sinks: whitespace matrices, CSV, JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.array import NDArray
from gridloom.operators.order import with_position


def read_matrix(spark: SparkSession, path: str) -> NDArray:
    """Whitespace-separated numbers, a row a line.

    Blank lines are skipped and a line ends at its first token that is no number;
    ragged rows and an empty file raise. Line order is kept by file and place in it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at")).where(F.length(F.trim("value")) > 0)
    numbers = F.transform(F.split(F.regexp_replace(F.trim("value"), r"\s+", " "), " "), lambda t: t.try_cast("double"))
    bad = F.array_position(F.transform(numbers, lambda x: x.isNull().cast("int")), 1)
    cut = F.when(bad > 0, F.slice(numbers, F.lit(1), (bad - 1).cast("int"))).otherwise(numbers)
    rows = lines.select("f", "at", cut.alias("xs")).where(F.size("xs") > 0)
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("xs")).alias("a"), F.max(F.size("xs")).alias("b")).first()
    if not shape["n"]:
        raise ValueError("the file holds no numbers")
    if shape["a"] != shape["b"]:
        raise ValueError("rows are not equally long")
    placed = with_position(rows, ["f", "at"], "i0")
    return NDArray(placed.select("i0", F.posexplode("xs").alias("i1", "v")), (shape["n"], shape["b"]))


def write_matrix(df: DataFrame, columns: list[str], keys: list[str], path: str) -> None:
    """The columns as lines of numbers, in the order of the keys."""
    df.orderBy(*keys).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True) -> DataFrame:
    """CSV; with a schema the file is read once, without one its types are inferred."""
    reader = spark.read.option("header", header)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
