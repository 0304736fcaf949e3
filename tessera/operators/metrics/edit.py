"""Word error rate.

Tokens: lower-cased, white-space-split (case-insensitive, no normalisation, punctuation kept).
Corpus rate = 100 * sum(edits) / sum(ref_len); empty references with a non-empty hypothesis give
100. Every distinct word of a pair becomes one code point above the basic plane and Spark's
``levenshtein`` runs on the coded strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import words_lower
from tessera.operators.metrics.rows import coded_words


def rate(edits: Column, ref_len: Column) -> Column:
    e, r = edits.cast("double"), ref_len.cast("double")
    return F.when(r > 0, F.lit(100.0) * e / r).when(e > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def with_edit_stats(df: DataFrame, keys: list[str], hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """Per-row ``(keys..., edits, ref_len)``: the word-level Levenshtein distance. A pair may hold 1,048,575 distinct words; more raise an error."""
    from tessera.session import ship_package

    ship_package(df.sparkSession)
    t = df.select(*keys, words_lower(F.col(hyp)).alias("_h"), words_lower(F.col(ref)).alias("_r"))
    t = t.select(*keys, F.greatest(F.size("_r"), F.lit(0)).cast("long").alias("ref_len"), coded_words("_h", "_r").alias("_c"))
    return t.select(*keys, F.levenshtein("_c.h", "_c.r").cast("long").alias("edits"), "ref_len")


def corpus_edit_rate(df: DataFrame, keys: list[str], hyp: str = "prediction", ref: str = "reference", name: str = "wer") -> DataFrame:
    """Summed edits over summed reference words."""
    st = with_edit_stats(df, keys, hyp, ref)
    agg = st.agg(F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"), F.count(F.lit(1)).alias("n_rows"))
    return agg.select(F.round(rate(F.col("edits"), F.col("ref_len")), 6).alias(name), "edits", "ref_len", "n_rows")
