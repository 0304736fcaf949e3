"""Scores as Column expressions over n-gram statistics.

* ``bleu_unsmoothed``: Papineni et al. (2002) as in the common corpus-BLEU code:
  p(n) = match/total (0 if total = 0); 0 if any p(n) = 0; else geometric mean
  times the brevity penalty; range 0-1. An empty hypothesis side gives 0.
* ``bleu_exp``: sacreBLEU's default "exp" smoothing, 0-100: no match at all -> 0;
  walk the orders upwards, stop at the first zero total; a zero match doubles k
  and uses 100 / (k * total).
* ``effective_order=True``: the mean runs over the orders with a non-zero total
  (sentence BLEU).
* ``chrf``: Popovic (2015) with sacreBLEU's averaging: precision and recall per
  order, averaged over orders where both sides have n-grams; beta = 2.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ORDERS = 4


def _getter(get):
    """Statistics are read by name from columns (aggregated frames) or from a struct."""
    g = get or F.col
    return lambda name: g(name).cast("double")


def brevity_penalty_hf(get=None) -> Column:
    _c = _getter(get)
    h, r = _c("hyp_len"), _c("ref_len")
    return F.when(h > r, F.lit(1.0)).when(h == 0, F.lit(0.0)).otherwise(F.exp(F.lit(1.0) - r / h))


def bleu_unsmoothed(get=None) -> Column:
    """A5, 0-1."""
    _c = _getter(get)
    ps = [F.when(_c(f"total_{n}") > 0, _c(f"match_{n}") / _c(f"total_{n}")).otherwise(F.lit(0.0)) for n in range(1, ORDERS + 1)]
    all_pos = ps[0] > 0
    for p in ps[1:]:
        all_pos = all_pos & (p > 0)
    logs = sum((F.log(F.when(p > 0, p).otherwise(F.lit(1.0))) for p in ps), F.lit(0.0))
    geo = F.when(all_pos, F.exp(logs / ORDERS)).otherwise(F.lit(0.0))
    return geo * brevity_penalty_hf(get)


def bleu_exp(effective_order: bool = False, get=None) -> Column:
    """A4 (corpus) / A6 (``effective_order=True``), 0-100."""
    _c = _getter(get)
    h, r = _c("hyp_len"), _c("ref_len")
    bp = F.when(h < r, F.when(h > 0, F.exp(F.lit(1.0) - r / h)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    zeros = F.lit(0)
    log_sum = F.lit(0.0)
    for n in range(1, ORDERS + 1):
        m, t = _c(f"match_{n}"), _c(f"total_{n}")
        zeros = zeros + F.when(m == 0, 1).otherwise(0)
        p = F.when(m > 0, F.lit(100.0) * m / t).otherwise(F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t))
        log_sum = log_sum + F.when(t > 0, F.log(p)).otherwise(F.lit(0.0))
    any_match = sum((_c(f"match_{n}") for n in range(1, ORDERS + 1)), F.lit(0.0)) > 0
    if effective_order:
        eff = sum((F.when(_c(f"total_{n}") > 0, 1).otherwise(0) for n in range(1, ORDERS + 1)), F.lit(0))
        score = bp * F.exp(log_sum / eff)
    else:
        eff = F.lit(ORDERS)
        # a zero total at any order leaves a zero precision: the score is 0
        score = F.when(_c(f"total_{ORDERS}") > 0, bp * F.exp(log_sum / ORDERS)).otherwise(F.lit(0.0))
    return F.when(any_match & (eff > 0), score).otherwise(F.lit(0.0))


def chrf(order: int = 6, beta: float = 2.0, get=None) -> Column:
    """A8, 0-100, from ``chyp_n``, ``cref_n``, ``cmatch_n``."""
    _c = _getter(get)
    eps = 1e-16
    factor = beta ** 2
    sp, sr, eff = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        hh, rr, mm = _c(f"chyp_{n}"), _c(f"cref_{n}"), _c(f"cmatch_{n}")
        sp = sp + F.when(hh > 0, mm / hh).otherwise(F.lit(eps))
        sr = sr + F.when(rr > 0, mm / rr).otherwise(F.lit(eps))
        eff = eff + F.when((hh > 0) & (rr > 0), 1).otherwise(0)
    ap = F.when(eff > 0, sp / eff).otherwise(F.lit(0.0))
    ar = F.when(eff > 0, sr / eff).otherwise(F.lit(0.0))
    return F.when(ap + ar > 0, F.lit(100.0) * (1 + factor) * ap * ar / (F.lit(factor) * ap + ar)).otherwise(F.lit(0.0))


def sentence_bleu(hyp_tokens: Column, ref_tokens: Column) -> Column:
    """A6 for one row, 0-100 (statistics bound once per row)."""
    from tessera.operators.metrics.ngrams import bleu_stats, let

    return let(bleu_stats(hyp_tokens, ref_tokens), lambda s: bleu_exp(True, get=lambda n: s[n]))


def r6(col: Column) -> Column:
    """Scores are compared at 6 decimals."""
    return F.round(col, 6)

