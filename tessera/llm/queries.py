"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import chat, conversation_repair, vector_codes
from tessera.llm.ann import nearest_neighbours
from tessera.llm.bpe_dropout import encode_documents
from tessera.llm.common import remainder, table
from tessera.llm.conversation_repair import repair_conversations
from tessera.llm.decontamination import find_leaks
from tessera.llm.language_id import identify
from tessera.llm.licenses import scan_licenses
from tessera.llm.lm_scoring import FOLD, score_documents
from tessera.llm.quality import classify
from tessera.llm.sharding import assign_shards
from tessera.llm.simhash import near_duplicates
from tessera.llm.token_counts import count_tokens
from tessera.llm.vector_codes import compress_vectors


def op1_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark window found in a document, with its place and edits."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learns from those whose crc32 remainder by 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    learn = remainder(F.col("doc_id"), 5) != 1
    return score_documents(docs, learn, learn & (remainder(F.col("doc_id"), 5 * FOLD) < 5))


def op3_bpe_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document under seeded merge dropout, decoded again as a check."""
    return encode_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learns from those whose crc32 remainder by 4 is not 2."""
    return identify(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) != 2)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal logged conversations, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return assign_shards(table(spark, sf_dir, "documents"))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, weak label and score of every document."""
    return classify(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every query vector."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the test damage."""
    return repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector."""
    return compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_qgram_decontamination, op2_context_mixing, op3_bpe_dropout, op4_language_id, op5_chat_format,
                                   op6_simhash, op7_jump_shards, op8_weak_quality, op9_ann, op10_licenses, op11_conversation_repair,
                                   op12_token_counts, op13_vector_codes)}
ORACLE: dict[str, str] = {"op5_chat_format": chat.ORACLE_SQL, "op11_conversation_repair": conversation_repair.ORACLE_SQL,
                          "op13_vector_codes": vector_codes.ORACLE_SQL}
