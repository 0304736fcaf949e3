"""Row filters.

F5, the synthetic-pair quality filter: when the original is Latin-only (P7) keep
the pair if the sentence BLEU of the back-translation against the original is at
least the threshold (score / 100); otherwise keep it if the length ratio
``len(trans) / max(1, len(orig))`` lies in [0.5, 2.0]. Only the Latin rows are
tokenised for BLEU, and n-grams are counted only where the lengths and the shared tokens leave the threshold in reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import contains_script, latin_only, length_ratio, py_split
from tessera.functions.tok13a import tokenize_13a
from tessera.operators.metrics.ngrams import COUNTED, LENGTHS, SHARED, with_bleu_above
from tessera.operators.metrics.scores import bleu_exp


def paragraph_ok(text, min_words: int = 10):
    """more than ``min_words`` whitespace words and not a ``==`` heading."""
    t = F.col(text) if isinstance(text, str) else text
    return (F.size(py_split(t)) > min_words) & ~t.startswith("==")


def script_ok(text, lo: int = 0x0F00, hi: int = 0x0FFF):
    """non-empty and holding a code point of the script."""
    t = F.col(text) if isinstance(text, str) else text
    return (F.length(t) > 0) & contains_script(t, lo, hi)


def decided_pairs(triples: DataFrame, keys: list[str], orig: str = "orig", trans: str = "trans", back: str = "back",
                  threshold: float = 0.7) -> DataFrame:
    """F5's decision for every row: ``(keys..., orig, trans, kept, decided_by, bleu, ratio)``.

    ``decided_by`` is "ratio" for an original that is not Latin-only. A Latin-only one is dropped by "lengths" or by "shared
    tokens" if these bound its sentence BLEU below the threshold; only else ("n-grams") are its n-grams counted and its
    ``bleu`` known. The bounds never drop a row that the score would keep.
    """
    t = triples.withColumn("_latin", latin_only(F.col(orig)))
    # only the Latin rows are tokenised; a missing side counts as empty
    tokens = [F.when(F.col("_latin"), tokenize_13a(F.coalesce(F.col(c), F.lit("")), rstrip=True)) for c in (back, orig)]
    st = with_bleu_above(t, [*keys, orig, trans, "_latin"], *tokens, threshold)
    score = bleu_exp(effective_order=True) / F.lit(100.0)
    ratio = length_ratio(F.col(trans), F.col(orig))
    by = F.when(~F.col("_latin"), "ratio").when(F.col("decided") == LENGTHS, "lengths").when(F.col("decided") == SHARED, "shared tokens").otherwise("n-grams")
    kept = F.when(F.col("_latin"), (F.col("decided") == COUNTED) & (score >= F.lit(threshold))).otherwise(F.coalesce(ratio.between(0.5, 2.0), F.lit(False)))
    return st.select(*keys, orig, trans, kept.alias("kept"), by.alias("decided_by"), F.when(F.col("decided") == COUNTED, score).alias("bleu"), ratio.alias("ratio"))


def quality_filter(triples: DataFrame, keys: list[str], orig: str = "orig", trans: str = "trans", back: str = "back",
                   threshold: float = 0.7, with_scores: bool = False) -> DataFrame:
    """F5 over ``(keys..., orig, trans, back)``; returns the kept ``(keys..., orig, trans)``."""
    out = decided_pairs(triples, keys, orig, trans, back, threshold).where("kept")
    return out.select(*keys, orig, trans, *(["bleu", "ratio"] if with_scores else []))


def filter_decisions(triples: DataFrame, keys: list[str], orig: str = "orig", trans: str = "trans", back: str = "back",
                     threshold: float = 0.7) -> DataFrame:
    """F5's report: rows and kept rows by what decided them."""
    d = decided_pairs(triples, keys, orig, trans, back, threshold)
    return d.groupBy("decided_by").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("kept").cast("long")).alias("n_kept"))
