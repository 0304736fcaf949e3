"""Per-row n-gram statistics, computed inside each row (no explode, no shuffle).

Clipped matches of two n-gram lists (sum over distinct grams of
``min(count in hyp, count in ref)``) are row-local. Two engines give the same
numbers: "jvm" sorts a tagged array and walks it once with ``aggregate`` (pure
Spark expressions, usable inside any expression, e.g. a filter); "arrow" counts
with ``collections.Counter`` in Arrow batches (3-4x faster here, because Spark
evaluates higher-order-function lambdas interpreted). Corpus statistics are
plain sums, combined map-side, so only one row per task reaches the final
aggregate.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _positions(m: Column) -> Column:
    """1..m as an array, empty when m <= 0 (``sequence(1, 0)`` would count down)."""
    return F.slice(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), 1, F.greatest(m, F.lit(0)))


def word_ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    return F.transform(_positions(F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))


def char_ngrams(s: Column, n: int) -> Column:
    return F.transform(_positions(F.length(s) - n + 1), lambda i: F.substring(s, i, n))


def clipped_matches(hyp: Column, ref: Column) -> Column:
    """Size of the multiset intersection of two string arrays."""
    tagged = F.sort_array(F.concat(
        F.transform(hyp, lambda g: F.struct(g.alias("g"), F.lit(1).alias("x"))),
        F.transform(ref, lambda g: F.struct(g.alias("g"), F.lit(0).alias("x"))),
    ))
    init = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("ch"), F.lit(0).alias("cr"), F.lit(0).alias("m"))

    def step(s, e):
        same = F.struct(s["p"].alias("p"), (s["ch"] + e["x"]).alias("ch"), (s["cr"] + 1 - e["x"]).alias("cr"), s["m"].alias("m"))
        new = F.struct(e["g"].alias("p"), e["x"].alias("ch"), (F.lit(1) - e["x"]).alias("cr"),
                       (s["m"] + F.least(s["ch"], s["cr"])).alias("m"))
        return F.when(s["p"].eqNullSafe(e["g"]), same).otherwise(new)

    return F.aggregate(tagged, init, step, lambda s: s["m"] + F.least(s["ch"], s["cr"]))


def let(value: Column, fn) -> Column:
    """``fn(v)`` with ``value`` evaluated once per row (bound to a lambda variable).

    Catalyst may inline projected columns into later expressions (a filter on
    top, a collapsed projection); a bound value is never recomputed inside the
    n-gram lambdas, whatever gets inlined.
    """
    return F.transform(F.array(value), fn).getItem(0)


def bleu_stats(hyp_tokens: Column, ref_tokens: Column) -> Column:
    """Struct of ``match_n``, ``total_n`` (n = 1..4), ``hyp_len``, ``ref_len`` for one row."""

    def body(x):
        h, r = x["h"], x["r"]
        cols = []
        for n in range(1, 5):
            cols.append(clipped_matches(word_ngrams(h, n), word_ngrams(r, n)).cast("long").alias(f"match_{n}"))
        for n in range(1, 5):
            cols.append(F.greatest(F.size(h) - n + 1, F.lit(0)).cast("long").alias(f"total_{n}"))
        cols.append(F.size(h).cast("long").alias("hyp_len"))
        cols.append(F.size(r).cast("long").alias("ref_len"))
        return F.struct(*cols)

    return let(F.struct(hyp_tokens.alias("h"), ref_tokens.alias("r")), body)


BLEU_STAT_COLS = [f"match_{n}" for n in range(1, 5)] + [f"total_{n}" for n in range(1, 5)] + ["hyp_len", "ref_len"]


def chrf_stats(hyp: Column, ref: Column) -> Column:
    """Struct of ``chyp_n``, ``cref_n``, ``cmatch_n``: character n-grams of the texts without whitespace."""
    from tessera.functions.text import WS_RUN

    def body(x):
        h, r = x["h"], x["r"]
        cols = []
        for n in range(1, 7):
            # a reference without an n-gram of this order adds nothing to the hypothesis' total
            total = F.when(F.length(r) >= n, F.greatest(F.length(h) - n + 1, F.lit(0))).otherwise(F.lit(0))
            cols.append(total.cast("long").alias(f"chyp_{n}"))
            cols.append(F.greatest(F.length(r) - n + 1, F.lit(0)).cast("long").alias(f"cref_{n}"))
            cols.append(clipped_matches(char_ngrams(h, n), char_ngrams(r, n)).cast("long").alias(f"cmatch_{n}"))
        return F.struct(*cols)

    return let(F.struct(F.regexp_replace(hyp, WS_RUN, "").alias("h"), F.regexp_replace(ref, WS_RUN, "").alias("r")), body)


CHRF_STAT_COLS = [f"{k}_{n}" for n in range(1, 7) for k in ("chyp", "cref", "cmatch")]


# ---------------------------------------------------------------- Arrow engine
# The same statistics counted with ``collections.Counter`` inside Arrow batches.
# Tokenisation stays JVM-side; Python only counts within one row, and the corpus
# sums are Spark aggregates. Measured at sf0.1: chrF statistics 1.7 s against
# 6.2 s for the higher-order-function walk, which Spark evaluates interpreted.
_BLEU_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in
                             [f"match_{n}" for n in range(1, 5)] + [f"total_{n}" for n in range(1, 5)] + ["hyp_len", "ref_len"]])
_CHRF_SCHEMA = T.StructType([T.StructField(f"{k}_{n}", T.LongType()) for n in range(1, 7) for k in ("chyp", "cref", "cmatch")])


def _grams(tokens, n):
    return Counter(zip(*(tokens[i:] for i in range(n))))


def clipped(a: Counter, b: Counter) -> int:
    """Size of the multiset intersection."""
    if len(a) > len(b):
        a, b = b, a
    return sum(min(n, b[g]) for g, n in a.items() if g in b)


def bleu_counts(a: list[str], b: list[str]) -> list[int]:
    """``match_n``, ``total_n`` (n = 1..4) and the two lengths of a row. Without matches of an order there are none of a higher one."""
    m = [0, 0, 0, 0]
    for n in range(1, 5):
        if len(a) >= n and len(b) >= n:
            m[n - 1] = clipped(_grams(a, n), _grams(b, n))
        if not m[n - 1]:
            break
    return m + [max(len(a) - n + 1, 0) for n in range(1, 5)] + [len(a), len(b)]


@F.pandas_udf(_BLEU_SCHEMA)
def _bleu_stats_arrow(h: pd.Series, r: pd.Series) -> pd.DataFrame:
    rows = [bleu_counts([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(h, r)]
    return pd.DataFrame(rows, columns=_BLEU_SCHEMA.fieldNames(), dtype="int64")


def chrf_counts(a: str, b: str) -> list[int]:
    """``chyp_n``, ``cref_n``, ``cmatch_n`` (n = 1..6) of a row."""
    out, shared = [], True
    for n in range(1, 7):
        na, nb = max(len(a) - n + 1, 0), max(len(b) - n + 1, 0)
        m = clipped(Counter([a[i:i + n] for i in range(na)]), Counter([b[i:i + n] for i in range(nb)])) if shared and na and nb else 0
        shared = m > 0
        # a reference without an n-gram of this order adds nothing to the hypothesis' total
        out += [na if nb else 0, nb, m]
    return out


@F.pandas_udf(_CHRF_SCHEMA)
def _chrf_stats_arrow(h: pd.Series, r: pd.Series) -> pd.DataFrame:
    rows = [chrf_counts(a or "", b or "") for a, b in zip(h, r)]
    return pd.DataFrame(rows, columns=_CHRF_SCHEMA.fieldNames(), dtype="int64")


def with_bleu_stats(df, keep: list[str], hyp_tokens: Column, ref_tokens: Column, engine: str = "arrow"):
    """Per-row BLEU statistics as columns (``engine``: "arrow" or "jvm"; same numbers)."""
    if engine == "arrow":
        from tessera.session import ship_package

        ship_package(df.sparkSession)
        t = df.select(*keep, hyp_tokens.alias("_h"), ref_tokens.alias("_r"))
        t = t.select(*keep, _bleu_stats_arrow(F.col("_h"), F.col("_r")).alias("_bs"))
    else:
        t = df.select(*keep, bleu_stats(hyp_tokens, ref_tokens).alias("_bs"))
    return t.select(*keep, *[F.col(f"_bs.{c}").alias(c) for c in BLEU_STAT_COLS])


def with_chrf_stats(df, keep: list[str], hyp: Column, ref: Column, engine: str = "arrow"):
    """Per-row chrF statistics as columns (``engine``: "arrow" or "jvm"; same numbers)."""
    from tessera.functions.text import WS_RUN

    if engine == "arrow":
        from tessera.session import ship_package

        ship_package(df.sparkSession)
        t = df.select(*keep, F.regexp_replace(hyp, WS_RUN, "").alias("_h"), F.regexp_replace(ref, WS_RUN, "").alias("_r"))
        t = t.select(*keep, _chrf_stats_arrow(F.col("_h"), F.col("_r")).alias("_cs"))
    else:
        t = df.select(*keep, chrf_stats(hyp, ref).alias("_cs"))
    return t.select(*keep, *[F.col(f"_cs.{c}").alias(c) for c in CHRF_STAT_COLS])


def sum_stats(df, cols: list[str], by: list[str] | None = None):
    """Corpus statistics: sums of the per-row statistics (grouped by ``by``)."""
    aggs = [F.sum(c).alias(c) for c in cols] + [F.count(F.lit(1)).alias("n_rows")]
    return df.groupBy(*(by or [])).agg(*aggs)


# ---------------------------------------------------------------- BLEU against a threshold
def bleu_bound(h: int, r: int, matches: int) -> float:
    """No less than the sentence BLEU (0-1, A6) of ``h`` and ``r`` tokens with at most ``matches`` shared ones.

    An order has at most as many matches as there are shared tokens, and as the shorter side has n-grams; without any match
    its smoothed precision is at most that of half a match.
    """
    if not h or not matches:
        return 0.0
    log, orders = 0.0, 0
    for n in range(1, 5):
        total = h - n + 1
        if total > 0:
            log += math.log(max(min(matches, total, r - n + 1), 0.5) / total)
            orders += 1
    return math.exp(min(0.0, 1 - r / h) + log / orders)


LENGTHS, SHARED, COUNTED = 1, 2, 3  # what decided a row


def bleu_counts_above(a: list[str], b: list[str], threshold: float) -> tuple[int, list[int]]:
    """How the row was decided, and its statistics. A row whose bound from the two lengths, or from its shared tokens,
    is below the threshold has statistics zero; its n-grams are not counted."""
    least = threshold - 1e-9
    if bleu_bound(len(a), len(b), min(len(a), len(b))) < least:
        return LENGTHS, [0] * 10
    if bleu_bound(len(a), len(b), clipped(Counter(a), Counter(b))) < least:
        return SHARED, [0] * 10
    return COUNTED, bleu_counts(a, b)


_ABOVE_SCHEMA = T.StructType([T.StructField("decided", T.IntegerType()), *_BLEU_SCHEMA.fields])


def with_bleu_above(df, keep: list[str], hyp_tokens: Column, ref_tokens: Column, threshold: float):
    """Like ``with_bleu_stats`` with a column ``decided``: null tokens are not looked at (0), rows that cannot reach
    ``threshold`` (0-1) are decided by their lengths (1) or shared tokens (2), the others are counted (3)."""
    from tessera.session import ship_package

    @F.pandas_udf(_ABOVE_SCHEMA)
    def counted(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(h, r):
            decided, stats = (0, [0] * 10) if a is None or b is None else bleu_counts_above(list(a), list(b), threshold)
            rows.append((decided, *stats))
        return pd.DataFrame(rows, columns=_ABOVE_SCHEMA.fieldNames())

    ship_package(df.sparkSession)
    t = df.select(*keep, hyp_tokens.alias("_h"), ref_tokens.alias("_r"))
    t = t.select(*keep, counted.asNondeterministic()("_h", "_r").alias("_bs"))
    return t.select(*keep, *[F.col(f"_bs.{c}").alias(c) for c in ("decided", *BLEU_STAT_COLS)])
