"""From raw documents to packed training sequences, in five stages.

Each stage works on every document that the one before it kept, and is
written as Parquet and read again before the next: a lost executor costs the
tasks it ran, and every stage can be started again from the table before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.llm import jaccard, packing, quality, shared, substring, toxicity


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not call toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return jaccard.one_of_each(docs)


def unrepeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word sequences that a document with a smaller id has already; text and n_chars are those of what is left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # Other columns travel under names of their own, so none can clash with what the operator adds.
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"other_{i}") for i, c in enumerate(rest)])
    kept = substring.remove_repeats(plain, columns=tuple(plain.columns[2:]))
    named = kept.select("doc_id", F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars"), *[F.col(f"other_{i}").alias(c) for i, c in enumerate(rest)])
    return named.select([F.col(f"`{c}`") for c in docs.columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, packed best-two-fit."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("toxicity", civil_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("substring dedup", unrepeated_text),
    ("best-fit packing", packed_sequences),
]
#: No SQL: the classifiers' decisions have none. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
