"""Corpus preparation: five stages, each written as Parquet and read again as the next one's documents.

Defined cases of every stage: null text counts as empty and stays null where the stage keeps texts; null
ids are kept; empty texts are judged like any other; texts of any length are read whole; extra columns are
dropped, whatever their names; an empty table gives an empty result. Rows that repeat an id and text are one in
the near-duplicate stage and are judged alike by the others; ties go to the smaller id, then source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import packing, quality, secrets, simhash, toxicity
from gridloom.llm.common import read_table, scope, shipped, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@shipped
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon calls toxic (a score of 0.5 or more) go, all others stay as they are."""
    own = docs.select(*COLUMNS)
    lexicon = toxicity.lexicon_of(own, read_table(spark, sf_dir, "labels"))
    return toxicity.scored(own, lexicon).where(F.col("score") < 0.5).select(*COLUMNS)


@shipped
def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (a score below 0.3) go, all others stay as they are."""
    rows = stage(quality.measured(docs.select(*COLUMNS)), "pipeline-measured")
    return quality.scored(rows, read_table(spark, sf_dir, "labels")).where(F.col("score") >= 0.3).select(*COLUMNS)


@shipped
def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays, and of rows that repeat it one.

    Documents without an id cannot stand for a group; they stay, and of equal texts one.
    """
    own, groups = docs.select(*COLUMNS), simhash.simhash_groups(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # the join deals rows by doc_id, which the ranking below asks for, too: texts move once
    named = _first_of_repeats(own.join(kept, "doc_id"))
    bare = _first_of_repeats(own.where(F.col("doc_id").isNull()))
    return named.unionByName(bare)


def _first_of_repeats(rows: DataFrame) -> DataFrame:
    repeats = Window.partitionBy("doc_id", "text").orderBy("source", "lang", "n_chars")
    return rows.withColumn("nth", F.row_number().over(repeats)).where("nth = 1").select(*COLUMNS)


@shipped
def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in a text gives way to a mark, and n_chars follows."""
    rows = stage(secrets.scanned(docs.select(*COLUMNS, F.coalesce("text", F.lit("")).alias("scanned")), "scanned").drop("scanned"), "pipeline-scanned")
    found = secrets.all_spans(rows, secrets.thresholds(rows))
    hit = F.size("spans") > 0
    text = F.when(hit, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("clean", text).select(
        "doc_id", F.col("clean").alias("text"), "lang", "source", F.when(hit, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows over all documents that are left: one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("quality", poor_out),
    ("near_dedup", near_copies_out),
    ("secrets", secrets_out),
    ("packing", packed),
]

#: Learned scores, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with scope(spark):  # what the stage itself has written goes once its rows are there
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
