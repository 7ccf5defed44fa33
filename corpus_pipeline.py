"""A corpus pipeline: quality classifier, n-gram Jaccard join, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and is written as Parquet and read again before the next. The first three return
the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrank.llm import jaccard_join, mil_quality, queries, secret_scan, store
from gridrank.llm.packing import pack


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject. A document without words has nothing to be judged by and stays."""
    model = mil_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil_quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, with all rows that repeat it. Rows without an id are in no group and stay."""
    groups = jaccard_join.join(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id")
    names = docs.columns
    return docs.join(gone, "doc_id", "left_anti").select(*names)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted again."""
    clean = secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_samples(docs)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold all documents."""
    return pack(docs, *queries.byte_tokenizer(), window=1024)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scan", secrets), ("packing", packing)]
#: No stage but the counting of patterns can be put in SQL; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
