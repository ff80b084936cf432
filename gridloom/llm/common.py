"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.package import ship

_LOCAL_DIRS: dict[str, str] = {}
#: Paths staged in each open scope, the innermost last.
_SCOPES: list[list[str]] = []
#: Keys with more than 1 / HEAVY of all rows are joined by broadcast: fewer than this many rows.
HEAVY = 2000


def shipped(f: Callable) -> Callable:
    """f(spark, ..) with the package sent first."""

    @wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-process
    session (as in tests) may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return _LOCAL_DIRS[sc.applicationId]


def _remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(where) if at_exit else files.delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. It goes with the scope that is open, at the latest when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    _remove(spark, path, at_exit=True)
    return path


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df into the shared folder and read it back: lineage is cut, losing an executor costs nothing.

    The table goes when the innermost ``scope`` closes; with ``keep``, when the one around it does.
    """
    spark = df.sparkSession
    own = _SCOPES.pop() if keep and _SCOPES else None
    try:
        path = scratch_path(spark, name)
    finally:
        if own is not None:
            _SCOPES.append(own)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end, but for those that are kept."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def spread_join(rows: DataFrame, known: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with known, in which every key stands once with its number of rows in ``weight``.

    A key that holds more than 1 / HEAVY of ``total`` rows is broadcast instead of shuffled, so
    no key is bound to one task; there are fewer than HEAVY such keys, whatever the data.
    """
    heavy = F.broadcast(known.where(F.col(weight) * HEAVY > total).drop(weight))
    light = known.where(F.col(weight) * HEAVY <= total).drop(weight)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key, how))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough that long texts do not pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_fold(id_col, folds: int = 5):
    """crc32 of the id's decimal text, modulo folds; null ids take part as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_labels(labels: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: fold not 0, label known.

    Of repeated ids with unlike labels the larger label holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return (
        known.where(crc_fold(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
