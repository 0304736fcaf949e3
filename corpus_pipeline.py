"""Corpus pipeline: documents -> language ID -> quality -> near-duplicates -> decontamination -> encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read back as the next stage's documents, so every stage works on all that its predecessor
kept. The first four return the columns of documents, the last the encoded rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.bpe_dropout import encode_documents
from tessera.llm.common import remainder, table
from tessera.llm.decontamination import without_leaks
from tessera.llm.language_id import keep_identified
from tessera.llm.quality import keep_good
from tessera.llm.simhash import keep_one
from tessera.session import shared_folder


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those rejected (no letters, or a narrow margin) go."""
    return keep_identified(docs, remainder(F.col("doc_id"), 4) != 2)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the documents that remain."""
    return encode_documents(docs)


STAGES = [("language_id", identified), ("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("encoding", encoded)]

#: Compression, trained models and fingerprints cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
