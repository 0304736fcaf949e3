"""All statistics of a scored row at once (A4-A9a, A11-A14), so that a report needs one pass.

One Arrow function counts within a row; tokenising before it and the sums after it are Spark's.
``ROW_STATS`` are integers that add up over rows; METEOR, a mean of row scores, adds up as a double.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions import text as tx
from tessera.functions.tok13a import tokenize_13a
from tessera.operators.metrics.ngrams import BLEU_STAT_COLS, CHRF_STAT_COLS, bleu_counts, chrf_counts

FIRST_CODE, LAST_CODE = 0x10000, 0x10FFFF
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5  # METEOR: weight of precision, power and weight of the fragmentation penalty
#: BLEU statistics of texts without their trailing white space (A4, A14); A5 and A13 keep it.
STRIPPED = [f"s_{c}" for c in BLEU_STAT_COLS]
METEOR = ["m_exact", "c_exact", "m_all", "c_all"]
ROW_STATS = [*BLEU_STAT_COLS, *STRIPPED, *CHRF_STAT_COLS]


def matched(h: list[str], r: list[str]) -> list[tuple[int, int]]:
    """Places of equal words, from last to first, each with the last free equal word of the other side."""
    free = defaultdict(list)
    for j, w in enumerate(r):
        free[w].append(j)
    return [(i, free[h[i]].pop()) for i in range(len(h) - 1, -1, -1) if free.get(h[i])]


def chunks(pairs: list[tuple[int, int]]) -> int:
    """Runs of matches that are adjacent on both sides."""
    pairs = sorted(pairs)
    return sum(i == 0 or (a[0] - pairs[i - 1][0], a[1] - pairs[i - 1][1]) != (1, 1) for i, a in enumerate(pairs))


@lru_cache(maxsize=50_000)
def _stem(word: str) -> str:
    from tessera.functions.porter import stem

    return stem(word)


def meteor_counts(h: list[str], r: list[str]) -> tuple[int, int, int, int]:
    """Matches and chunks of equal words, then with the words left over matched by their Porter stems."""
    exact = matched(h, r)
    hs, rs = ({x[k] for x in exact} for k in (0, 1))
    ih, ir = ([i for i in range(len(w)) if i not in used] for w, used in ((h, hs), (r, rs)))
    stems = matched([_stem(h[i]) for i in ih], [_stem(r[j]) for j in ir]) if ih and ir else []
    every = exact + [(ih[a], ir[b]) for a, b in stems]
    return len(exact), chunks(exact), len(every), chunks(every)


def coded(h: list[str], r: list[str]) -> tuple[str, str]:
    """Both word lists as strings of one code point per distinct word, above the basic plane."""
    codes: dict[str, str] = {}
    out = tuple("".join([codes.get(w) or codes.setdefault(w, chr(FIRST_CODE + len(codes))) for w in words]) for words in (h, r))
    if len(codes) > LAST_CODE - FIRST_CODE:
        raise ValueError("a pair holds too many distinct words")
    return out


def _listed(s: pd.Series) -> Iterator[list[str]]:
    """One row's list at a time."""
    return ([] if x is None else list(x) for x in s)


_METEOR_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in METEOR])
_CODE_SCHEMA = T.StructType([T.StructField("h", T.StringType()), T.StructField("r", T.StringType())])
_ALL_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in [*ROW_STATS, *METEOR]] + _CODE_SCHEMA.fields)


@F.pandas_udf(_METEOR_SCHEMA)
def meteor_stats(h: pd.Series, r: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([meteor_counts(a, b) for a, b in zip(_listed(h), _listed(r))], columns=METEOR, dtype="int64")


@F.pandas_udf(_CODE_SCHEMA)
def coded_words(h: pd.Series, r: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([coded(a, b) for a, b in zip(_listed(h), _listed(r))], columns=["h", "r"])


@F.pandas_udf(_ALL_SCHEMA)
def _all_stats(h: pd.Series, r: pd.Series, sh: pd.Series, sr: pd.Series, hc: pd.Series, rc: pd.Series, hw: pd.Series, rw: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, c, d, e, f, g, k in zip(_listed(h), _listed(r), sh, sr, hc, rc, _listed(hw), _listed(rw)):
        bleu = bleu_counts(a, b)
        stripped = bleu if c is None and d is None else bleu_counts(a if c is None else list(c), b if d is None else list(d))
        rows.append((*bleu, *stripped, *chrf_counts(e or "", f or ""), *meteor_counts(g, k), *coded(g, k)))
    return pd.DataFrame(rows, columns=_ALL_SCHEMA.fieldNames())


def meteor_score(m: Column, c: Column, hyp_len: Column, ref_len: Column) -> Column:
    """A7 from matches, chunks and the two lengths; no match gives 0."""
    n, p, q = m.cast("double"), m / hyp_len, m / ref_len
    score = (F.lit(1.0) - F.lit(GAMMA) * F.pow(c / n, F.lit(BETA))) * p * q / (F.lit(ALPHA) * p + F.lit(1 - ALPHA) * q)
    return F.when(m > 0, score).otherwise(F.lit(0.0))


def with_row_stats(examples: DataFrame, keep: list[str], source: str = "source", hyp: str = "prediction", ref: str = "reference",
                   lo: int = 0x0F00, hi: int = 0x0FFF) -> DataFrame:
    """``(keep..., statistics)``: what every metric and report needs of a row, as columns to be summed.

    ``bucket`` is the length bucket of the source (A13), ``word_diff`` and ``script`` serve A11 and A12, ``edits`` and
    ``ref_words`` the word error rate, ``meteor_exact`` and ``meteor_exact_stem`` the row's METEOR.
    """
    from tessera.session import ship_package

    ship_package(examples.sparkSession)
    h, r = F.col(hyp), F.col(ref)
    # trailing white space matters to the tokeniser only after a hyphen at the end of a line
    tail = f"(?U)-\\n{tx.WS_CLASS}*\\z"
    narrow = examples.select(
        *keep, tx.length_bucket(tx.word_count(F.col(source))).alias("bucket"), tokenize_13a(h).alias("_h"), tokenize_13a(r).alias("_r"),
        F.when(h.rlike(tail), tokenize_13a(h, True)).alias("_sh"), F.when(r.rlike(tail), tokenize_13a(r, True)).alias("_sr"),
        F.regexp_replace(h, tx.WS_RUN, "").alias("_hc"), F.regexp_replace(r, tx.WS_RUN, "").alias("_rc"),
        tx.words_lower(h).alias("_hw"), tx.words_lower(r).alias("_rw"), tx.contains_script(h, lo, hi).cast("long").alias("script"))
    counted = narrow.select(*keep, "bucket", "script", F.size("_hw").alias("hyp_words"), F.size("_rw").alias("ref_words"),
                            _all_stats("_h", "_r", "_sh", "_sr", "_hc", "_rc", "_hw", "_rw").alias("_s"))
    hw, rw = F.greatest(F.col("hyp_words"), F.lit(0)), F.greatest(F.col("ref_words"), F.lit(0))  # null texts have size -1
    return counted.select(
        *keep, "bucket", "script", (hw - rw).cast("long").alias("word_diff"), rw.cast("long").alias("ref_words"),
        F.levenshtein("_s.h", "_s.r").cast("long").alias("edits"), *[F.col(f"_s.{c}").alias(c) for c in ROW_STATS],
        meteor_score(F.col("_s.m_exact"), F.col("_s.c_exact"), hw, rw).alias("meteor_exact"),
        meteor_score(F.col("_s.m_all"), F.col("_s.c_all"), hw, rw).alias("meteor_exact_stem"))


SUMS = ["script", "word_diff", "ref_words", "edits", *ROW_STATS]
MEANS = ["meteor_exact", "meteor_exact_stem"]


def summed() -> list[Column]:
    """Aggregates over the columns of ``with_row_stats``; they combine map-side."""
    return [F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in SUMS], *[F.avg(c).alias(c) for c in MEANS]]
