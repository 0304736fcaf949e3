"""Structured Streaming entry points for the batch operators.

The reference has no streaming; these run the same operators on files as they
arrive, so an evaluation or translation job can be fed continuously:

* ``corpus_scores_stream``: per-row BLEU and chrF statistics, summed in a
  streaming aggregation. The state is one row of counters (BLEU and chrF are
  sums of integer statistics), so it stays constant however long the stream runs.
* ``translate_stream``: each micro-batch is translated with the dictionary join and
  written to a folder of its own (``batch_id=N``), overwriting it if the batch is
  repeated after a restart, so every text is in the output once.

The caller names the checkpoint folder, which must outlive the application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import Script
from tessera.functions.tok13a import tokenize_13a
from tessera.operators.dictionary import translate
from tessera.operators.metrics.ngrams import BLEU_STAT_COLS, CHRF_STAT_COLS, bleu_stats, chrf_stats
from tessera.operators.metrics.scores import bleu_exp, bleu_unsmoothed, chrf, r6

SCORED_SCHEMA = "id long, source string, reference string, prediction string"


def scored_stream(spark: SparkSession, path: str, schema: str = SCORED_SCHEMA, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def corpus_scores_stream(examples: DataFrame) -> DataFrame:
    """Running corpus BLEU (0-1 and smoothed 0-100) and chrF over a stream of scored examples."""
    per_row = examples.select(
        bleu_stats(tokenize_13a(F.col("prediction")), tokenize_13a(F.col("reference"))).alias("_b"),
        chrf_stats(F.col("prediction"), F.col("reference")).alias("_c"),
    )
    cols = [F.col(f"_b.{c}").alias(c) for c in BLEU_STAT_COLS] + [F.col(f"_c.{c}").alias(c) for c in CHRF_STAT_COLS]
    sums = per_row.select(*cols).agg(*[F.sum(c).alias(c) for c in BLEU_STAT_COLS + CHRF_STAT_COLS],
                                     F.count(F.lit(1)).alias("n_rows"))
    return sums.select(r6(bleu_unsmoothed()).alias("bleu"), r6(bleu_exp()).alias("bleu_smoothed"),
                       r6(chrf()).alias("chrf"), "n_rows")


def start_scores(spark: SparkSession, examples: DataFrame, name: str, checkpoint: str):
    """Run ``corpus_scores_stream`` into an in-memory table ``name`` (complete mode)."""
    return (corpus_scores_stream(examples).writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).start())


def translate_stream(spark: SparkSession, texts: DataFrame, keys: list[str], text_col: str, view: DataFrame,
                     src: Script, joiner: str, out_path: str, checkpoint: str):
    """Translate every micro-batch by the dictionary join into its folder of ``out_path``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        out = translate(batch, keys, text_col, view, src, joiner)
        out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
