"""METEOR (A7): exact matches, then matches of Porter stems, then the fragmentation penalty.

The alignment takes words from last to first, each with the last free equal word of the
other side. It is counted within a row, in Arrow batches; nothing is shuffled.

[pin] tokens are lower-cased and split on white space (a word tokeniser would also part
punctuation); there is no synonym stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import words_lower
from tessera.operators.metrics.rows import meteor_score, meteor_stats


def with_meteor(df: DataFrame, keys: list[str], hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """``(keys..., meteor_exact, meteor_exact_stem)`` for every row."""
    from tessera.session import ship_package

    ship_package(df.sparkSession)
    rows = df.select(*keys, words_lower(F.col(hyp)).alias("_h"), words_lower(F.col(ref)).alias("_r"))
    rows = rows.select(*keys, F.size("_h").alias("_nh"), F.size("_r").alias("_nr"), meteor_stats("_h", "_r").alias("_m"))
    return rows.select(*keys, meteor_score(F.col("_m.m_exact"), F.col("_m.c_exact"), F.col("_nh"), F.col("_nr")).alias("meteor_exact"),
                       meteor_score(F.col("_m.m_all"), F.col("_m.c_all"), F.col("_nh"), F.col("_nr")).alias("meteor_exact_stem"))


def corpus_meteor(df: DataFrame, keys: list[str], hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """Mean sentence METEOR, with equal words only and with stems."""
    m = with_meteor(df, keys, hyp, ref)
    return m.agg(F.round(F.avg("meteor_exact"), 6).alias("meteor_exact"), F.round(F.avg("meteor_exact_stem"), 6).alias("meteor_exact_stem"),
                 F.count(F.lit(1)).alias("n_rows"))
