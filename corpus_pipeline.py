"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import decontaminate, minhash, packing, secrets, toxicity
from factloom.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; the lexicon is learned from labelled rows of docs.

    Each row is judged by its own text, whatever its id. A column named score is kept as it is.
    """
    lexicon = toxicity.learned_from(spark, docs, sf_dir)
    return toxicity.score(docs, lexicon, score_col="__toxicity").where(F.col("__toxicity") < 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one of smallest doc_id (null ids last).

    Rows are told apart by a number of their own that is written with them, so
    rows that share an id or have none are judged by their texts. Rows with a
    null text are in no class and all stay.
    """
    numbered = _numbered(docs)
    classes = minhash.near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__row").alias("row"))
    keep = classes.join(numbered.select("__row", "doc_id"), "__row").groupBy("class_id").agg(F.min(order).alias("first"))
    return numbered.join(keep.select(F.col("first.row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs, written with a number of its own for each row."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that occur in benchmark items."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are masked; rows that share an id or have none are judged by their own texts."""
    numbered = _numbered(docs)
    found = secrets.scan(numbered.select(F.col("__row").alias("doc_id"), "text"))
    return secrets.redact(numbered, found.withColumnRenamed("doc_id", "__row"), id_col="__row").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training windows."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
