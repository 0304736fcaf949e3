"""Data Spark derives from the driver tables, shared by the registered queries.

* pairs (D1/D8): a user turn t with the assistant turn t+1 of the same
  conversation. The join key is (conv_id, turn), so a conversation with very
  many turns still spreads over all tasks.
* hub table (D8): ``(conv_id, turn, source, reference, prediction)`` where the
  prediction is the dictionary translation of the source with the dictionary
  induced from all pairs (the reference's translate-then-score flow).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import ENGLISH, LATIN_MARKS
from tessera.operators.dictionary import both_ways, dictionary_entries, forward_view, induce_dictionary, translate
from tessera.plans.physical import cut_lineage, dealt_by_rows

PAIR_KEYS = ["conv_id", "turn"]
PAIRS_PER_TASK = 2048  # scoring costs milliseconds a pair
SRC_SCRIPT = LATIN_MARKS  # source side of the stand-in corpus: marks, case kept
TGT_SCRIPT = ENGLISH      # target side: lower-cased words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    reply = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return user.join(reply, PAIR_KEYS)


def pair_dictionary(pairs: DataFrame) -> DataFrame:
    return induce_dictionary(pairs, "src", "tgt", SRC_SCRIPT, TGT_SCRIPT, PAIR_KEYS)


def scored_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 hub table."""
    pairs = conversation_pairs(spark, sf_dir)
    view = forward_view(dictionary_entries(pair_dictionary(pairs)))
    t = translate(pairs, PAIR_KEYS, "src", view, SRC_SCRIPT, TGT_SCRIPT.joiner, "prediction")
    return t.select(*PAIR_KEYS, F.col("src").alias("source"), F.col("tgt").alias("reference"), "prediction")


def translated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with both translations beside each other, each with its own dictionary direction."""
    pairs = cut_lineage(conversation_pairs(spark, sf_dir), "pairs")  # read for the dictionary and for the translations
    entries = cut_lineage(dictionary_entries(pair_dictionary(pairs)), "entries")  # both views read it
    return both_ways(dealt_by_rows(pairs, PAIRS_PER_TASK), entries, PAIR_KEYS, "src", "tgt", SRC_SCRIPT, TGT_SCRIPT, dealt=True)


def both_direction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 input: the set and its swap, two rows per pair from one pass."""
    def example(direction, source, reference, prediction):
        return F.struct(F.lit(direction).alias("direction"), *[F.col(k) for k in PAIR_KEYS], F.col(source).alias("source"),
                        F.col(reference).alias("reference"), F.col(prediction).alias("prediction"))

    return translated_pairs(spark, sf_dir).select(F.inline(F.array(
        example("src-tgt", "original_src", "actual_tgt", "translated_tgt"), example("tgt-src", "actual_tgt", "original_src", "translated_src"))))
