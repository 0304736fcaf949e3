"""Plain-Python twins of the metric definitions, written from the published descriptions."""

from __future__ import annotations

import math
import re
from collections import Counter


def tok13a(line: str, rstrip: bool = False) -> list[str]:
    if rstrip:
        line = line.rstrip()
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def ngram_counts(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def bleu_stats(hyp_tokens, ref_tokens, order=4):
    m = [sum((ngram_counts(hyp_tokens, n) & ngram_counts(ref_tokens, n)).values()) for n in range(1, order + 1)]
    t = [max(0, len(hyp_tokens) - n + 1) for n in range(1, order + 1)]
    return m, t, len(hyp_tokens), len(ref_tokens)


def bleu_unsmoothed(m, t, hl, rl):
    ps = [mm / tt if tt > 0 else 0.0 for mm, tt in zip(m, t)]
    geo = math.exp(sum(math.log(p) for p in ps) / 4) if min(ps) > 0 else 0.0
    if hl == 0:
        return 0.0
    bp = 1.0 if hl > rl else math.exp(1 - rl / hl)
    return geo * bp


def bleu_exp(m, t, hl, rl, effective_order=False):
    bp = 1.0 if hl >= rl else (math.exp(1 - rl / hl) if hl > 0 else 0.0)
    if not any(m):
        return 0.0
    precisions = [0.0] * 4
    smooth, eff = 1.0, 4
    for n in range(1, 5):
        if t[n - 1] == 0:
            break
        if effective_order:
            eff = n
        if m[n - 1] == 0:
            smooth *= 2
            precisions[n - 1] = 100.0 / (smooth * t[n - 1])
        else:
            precisions[n - 1] = 100.0 * m[n - 1] / t[n - 1]
    logs = sum(math.log(p) if p > 0 else -9999999999 for p in precisions[:eff])
    return bp * math.exp(logs / eff)


def chrf_stats(hyp: str, ref: str, order=6):
    h, r = "".join(hyp.split()), "".join(ref.split())
    out = []
    for n in range(1, order + 1):
        hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
        rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
        out.append((sum(hc.values()) if rc else 0, sum(rc.values()), sum((hc & rc).values())))
    return out


def chrf(stats, beta=2.0):
    eps = 1e-16
    f = beta ** 2
    sp = sr = 0.0
    eff = 0
    for nh, nr, nm in stats:
        sp += nm / nh if nh > 0 else eps
        sr += nm / nr if nr > 0 else eps
        eff += 1 if nh > 0 and nr > 0 else 0
    if eff == 0:
        return 0.0
    ap, ar = sp / eff, sr / eff
    return 100 * (1 + f) * ap * ar / (f * ap + ar) if ap + ar > 0 else 0.0


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return prev[-1]


def meteor_row(hyp: list[str], ref: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR of one pair: exact, then Porter-stem alignment (last-to-first greedy), fragmentation penalty."""
    from tessera.functions.porter import stem

    h = list(enumerate(hyp))
    r = list(enumerate(ref))
    matches = []
    for key in (lambda w: w, stem):
        for i in range(len(h))[::-1]:
            for j in range(len(r))[::-1]:
                if key(h[i][1]) == key(r[j][1]):
                    matches.append((h[i][0], r[j][0]))
                    h.pop(i)
                    r.pop(j)
                    break
    n = len(matches)
    if not hyp or not ref or n == 0:
        return 0.0
    p, rc = n / len(hyp), n / len(ref)
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    matches.sort()
    chunks = 1
    for k in range(n - 1):
        if not (matches[k + 1][0] == matches[k][0] + 1 and matches[k + 1][1] == matches[k][1] + 1):
            chunks += 1
    return (1 - gamma * (chunks / n) ** beta) * fmean


