"""Operator 8: quality classifier from weak labels.

Overlapping heuristic labellers vote on every text: good (+1), bad (-1) or no opinion (0).
Their votes are counted by pattern over all rows (at most 3**8 patterns reach the driver),
and expectation-maximisation on these counts estimates how each labeller votes on good and
on bad texts and how common bad texts are. The posterior of each pattern is the soft label
on which a hashed linear scorer (logistic regression over hashed tokens, token shapes and
bucketed statistics) is trained; the scorer judges every whole text.

The scorer is fitted on a sample of at most ``train_rows`` rows and ``train_bytes`` bytes of
text, drawn row by row (rows that share an id or a text are drawn one by one); votes,
patterns and scores cover all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import materialise, prepare

TRAIN_ROWS = 20_000
TRAIN_BYTES = 128 << 20
SHARDS = 8
DIM = 1 << 18
EPOCHS = 4
MIN_SCORE = 0.5
SYMBOLS = b"#$%&*|~^<>{}[]\\=@+_"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
LABELLERS = ("symbols", "sign_runs", "separators", "upper_case", "shouting", "repeats", "dull_blocks", "word_length")
SEPARATOR = re.compile(rb"(?<!\S)[|\-_=*#~.:/\\]+(?!\S)")  # a word of separating signs only
RUN = re.compile(rb"([#$%&*|~^<>=@+!?])\1")


def _dull_blocks(words: list[bytes], size: int = 40) -> float:
    """The share of full blocks of ``size`` words with fewer than half as many distinct ones."""
    full = len(words) // size
    return sum(len(set(words[i * size:(i + 1) * size])) * 2 < size for i in range(full)) / max(full, 1)


def statistics(raw: bytes, words: list[bytes]) -> dict[str, float]:
    """What the labellers look at: shares between 0 and 1, and the mean word length in bytes."""
    n = max(len(words), 1)
    signs = sum(map(len, words)) or 1
    upper = len(raw) - len(raw.translate(None, UPPER))
    lower = len(raw) - len(raw.translate(None, LOWER))
    return {
        "symbols": (len(raw) - len(raw.translate(None, SYMBOLS))) / signs,
        "sign_runs": sum(1 for w in words if RUN.search(w)) / n if RUN.search(raw) else 0.0,
        "separators": len(SEPARATOR.findall(raw)) / n,
        "upper_case": upper / max(upper + lower, 1),
        "dull_blocks": _dull_blocks(words),
        "repeats": sum(map(eq, words, words[1:])) / n,
        "shouting": sum(1 for w in words if w.endswith((b"!!", b"??"))) / n if b"!!" in raw or b"??" in raw else 0.0,
        "word_length": signs / n,
    }


#: labeller -> (good up to, bad from); between them no opinion
LIMITS = {"symbols": (0.03, 0.08), "sign_runs": (0.02, 0.1), "separators": (0.03, 0.12), "upper_case": (0.2, 0.5),
          "shouting": (0.02, 0.1), "repeats": (0.05, 0.15), "dull_blocks": (0.05, 0.15)}


def votes(s: dict[str, float]) -> tuple[int, ...]:
    out = []
    for name, (good, bad) in LIMITS.items():
        out.append(1 if s[name] <= good else -1 if s[name] >= bad else 0)
    length = s["word_length"]
    out.append(-1 if length < 2 or length > 25 else 1 if 3 <= length <= 12 else 0)
    return tuple(out)


def pattern(text: str | None) -> str | None:
    """The votes as text, one sign each; null for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return None
    return "".join("-0+"[v + 1] for v in votes(statistics(raw, words)))


def fit_labellers(counts: dict[str, int], rounds: int = 50) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over pattern counts: the share of bad texts, P(vote | bad or good) [2, labellers, 3], and P(bad | pattern).

    Starts from: bad if two labellers say so, perhaps bad if one does. Counts are smoothed by one vote of each kind.
    """
    keys = sorted(counts)
    if not keys:
        return 0.0, np.full((2, len(LABELLERS), 3), 1 / 3), {}
    v = np.array([["-0+".index(c) for c in k] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    hot = np.eye(3)[v]                                          # [patterns, labellers, 3]
    bad = np.select([(v == 0).sum(axis=1) > 1, (v == 0).any(axis=1)], [0.98, 0.6], 0.02)
    for _ in range(rounds):
        share = float((n * bad).sum() + 1) / (n.sum() + 2)
        given = np.stack([(np.einsum("p,plv->lv", n * r, hot) + 1) / ((n * r).sum() + 3) for r in (bad, 1 - bad)])
        log = [np.log(p) + np.einsum("plv,lv->p", hot, np.log(t)) for p, t in zip((share, 1 - share), given)]
        bad = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return share, given, dict(zip(keys, bad.tolist()))


_CACHE: dict[bytes, tuple[int, int]] = {}
_SHAPES: dict[bytes, int] = {}
#: Small letters and bytes of other signs as "a", digits as "0".
CLASSES = bytes(ord("a") if c >= 128 or chr(c) in "abcdefghijklmnopqrstuvwxyz" else ord("0") if chr(c) in "0123456789" else c for c in range(256))


def _shape_feature(classes: bytes) -> int:
    """The hashed feature of a token's shape: runs of small letters, of digits and of capitals in short."""
    got = _SHAPES.get(classes)
    if got is None:
        if len(_SHAPES) >= 20_000:
            _SHAPES.clear()
        shape = re.sub(rb"a+", b"a", re.sub(rb"[A-Z]{2,}", b"AA", re.sub(rb"0+", b"0", classes)))
        got = _SHAPES[classes] = zlib.crc32(b"s" + shape) % DIM
    return got


def _token_features(word: bytes) -> tuple[int, int]:
    got = _CACHE.get(word)
    if got is None:
        if len(_CACHE) >= 100_000:
            _CACHE.clear()
        got = _CACHE[word] = (zlib.crc32(b"t" + word.lower()) % DIM, _shape_feature(word.translate(CLASSES)))
    return got


def features(words: list[bytes], stats: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (indexes, values) of a whole text's words and statistics."""
    idx, val = [], []
    n = max(len(words), 1)
    for w, c in Counter(words).items():
        t, s = _token_features(w)
        idx += (t, s)
        val += (c / n, 3 * c / n)
    idx += bucket_features(stats)
    val += [1.0] * len(stats)
    return np.array(idx, np.int64), np.array(val)


def bucket_features(stats: dict[str, float]) -> list[int]:
    """The hashed feature of each statistic's bucket; its value is one."""
    steps = ((name, round(x / 2) if name == "word_length" else int(min(x, 0.99) * 20)) for name, x in stats.items())
    return [zlib.crc32(f"b{name}{step}".encode()) % DIM for name, step in steps]


class TokenWeights(dict):
    """What one occurrence of a token adds to the score of a text, times the text's number of words; bounded."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 100_000:
            self.clear()
        t, s = zlib.crc32(b"t" + word.lower()) % DIM, _shape_feature(word.translate(CLASSES))
        x = self[word] = float(self.weights[t]) + 3 * float(self.weights[s])
        return x


def score(words: list[bytes], stats: dict[str, float], tokens: TokenWeights, bias: float) -> float:
    """P(good): the scorer's sum over ``features``, word by word."""
    total = sum(map(tokens.__getitem__, words)) / max(len(words), 1) + sum(tokens.weights[bucket_features(stats)].tolist()) + bias
    return 1 / (1 + math.exp(-min(max(total, -30.0), 30.0)))


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode()
    words = raw.split()
    return features(words, statistics(raw, words))


def _train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """AdaGrad logistic regression over one shard of the sample; the target is P(good)."""
    data = [(*text_features(t), 1 - b) for t, b in zip(pdf.sort_values("draw")["text"], pdf.sort_values("draw")["bad"])]
    w, g, bias = np.zeros(DIM), np.full(DIM, 1e-6), 0.0
    for _ in range(EPOCHS):
        for i, x, y in data:
            err = y - 1 / (1 + np.exp(-np.clip(w[i] @ x + bias, -30, 30)))
            grad = err * x
            np.add.at(g, i, grad * grad)
            np.add.at(w, i, 0.3 * grad / np.sqrt(g[i]))
            bias += 0.01 * err
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], bias), "rows": float(len(pdf))})


def training_sample(src: DataFrame, total: int, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The rows of ``src`` (``_id, text``) to train on: ``text, draw, shard``; ``total`` is how many rows have words.

    Every row has a draw and a shard of its own, by two hashes of its place, id and text. The
    drawn rows are written, so that each later use reads the same ones. Of them the first in
    draw order stay, up to both bounds; a first text beyond ``train_bytes`` stays alone. The
    driver sees the draw and size of about ``train_rows`` rows.
    """
    row = [F.monotonically_increasing_id(), F.col("_id"), F.col("text")]
    drawn = materialise(
        src.where(F.col("text").rlike(r"\S"))
        .select("text", F.pmod(F.xxhash64(F.lit("draw"), *row), F.lit(1 << 62)).alias("draw"),
                F.pmod(F.xxhash64(F.lit("shard"), *row), F.lit(SHARDS)).alias("shard"))
        .where(F.col("draw") < int((1 << 62) * min(1.0, train_rows / total))), "quality-sample")
    sizes = drawn.select("draw", F.octet_length("text").cast("long").alias("n")).toArrow()
    draws, n = sizes["draw"].to_numpy(), sizes["n"].to_numpy()
    by = np.argsort(draws)
    fits = int(np.searchsorted(np.cumsum(n[by]), train_bytes, side="right"))
    stay = by[:min(max(fits, 1), train_rows)]
    return drawn.where(F.col("draw") <= int(draws[stay[-1]])) if len(stay) else drawn


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES):
    """(labellers' EM result, weights, bias) learnt from ``docs``; weights are None for a table without words."""
    spark = docs.sparkSession

    @F.pandas_udf("string")
    def pattern_of(text: pd.Series) -> pd.Series:
        return pd.Series([pattern(t) for t in text], dtype=object)

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    counts = {r["p"]: r["count"] for r in src.select(pattern_of("text").alias("p")).where("p is not null").groupBy("p").count().collect()}
    labellers = fit_labellers(counts)
    total = sum(counts.values())
    if not total:
        return labellers, None, 0.0
    bad = spark.sparkContext.broadcast(labellers[2])

    @F.pandas_udf("double")
    def bad_of(p: pd.Series) -> pd.Series:
        return p.map(bad.value).astype(float)

    sample = (training_sample(src, total, train_rows, train_bytes).select("text", "draw", "shard", pattern_of("text").alias("p"))
              .where("p is not null").select("text", "draw", "shard", bad_of("p").alias("bad")))
    trained = sample.groupBy("shard").applyInPandas(
        lambda pdf: _train_shard(pdf), "at int, w double, rows double")
    trained = trained.groupBy("at").agg(F.sum(F.col("w") * F.col("rows")).alias("w"), F.max("rows"), F.sum("rows").alias("n")).collect()
    weights, rows = np.zeros(DIM), max((r["n"] for r in trained), default=1.0)
    bias = 0.0
    for r in trained:
        if r["at"] < 0:
            bias = r["w"] / rows
        else:
            weights[r["at"]] = r["w"] / rows
    return labellers, weights, bias


def scorer(spark: SparkSession, weights: np.ndarray | None, bias: float):
    """Column function: text -> P(good) by the linear scorer. Texts without words get 0."""
    shared = spark.sparkContext.broadcast((None if weights is None else weights.astype(np.float32), bias))

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        tokens = None if w is None else TokenWeights(w)
        try:
            for texts in batches:
                out = []
                for t in texts:
                    raw = (t or "").encode()
                    words = raw.split()
                    out.append(score(words, statistics(raw, words), tokens, b) if words and tokens is not None else 0.0)
                yield pd.Series(out, dtype=float)
        finally:
            _CACHE.clear()

    return quality


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS,
             min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, votes, weak_bad, score, accepted`` for every row (repeated rows each).

    ``votes`` has one sign per labeller, ``weak_bad`` the posterior of that pattern. Null,
    empty and blank texts have null votes, score 0 and are rejected; an empty table gives no
    rows. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    labellers, weights, bias = fit(docs, id_col, text_col, train_rows)
    shared = spark.sparkContext.broadcast((labellers[2], None if weights is None else weights.astype(np.float32), bias))

    @F.pandas_udf("votes string, weak_bad double, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bad, w, b = shared.value
        tokens = None if w is None else TokenWeights(w)
        try:
            for texts in batches:
                rows = []
                for t in texts:
                    raw = (t or "").encode()
                    words = raw.split()
                    if not words:
                        rows.append((None, None, 0.0))
                        continue
                    stats = statistics(raw, words)
                    p = "".join("-0+"[v + 1] for v in votes(stats))
                    rows.append((p, bad.get(p), score(words, stats, tokens, b) if tokens is not None else 0.0))
                yield pd.DataFrame(rows, columns=["votes", "weak_bad", "score"]).astype({"weak_bad": float, "score": float})
        finally:
            _CACHE.clear()

    out = docs.select(F.col(id_col).alias("doc_id"), judged(F.col(text_col).cast("string")).alias("v"))
    return out.select("doc_id", "v.votes", F.nanvl("v.weak_bad", F.lit(None).cast("double")).alias("weak_bad"), "v.score",
                      (F.col("v.score") >= min_score).alias("accepted"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE, **options) -> DataFrame:
    """The rows that the classifier accepts, all columns kept. Null, empty and blank texts go; repeated rows are judged alike and
    each kept; a very long text is judged whole; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    _, weights, bias = fit(docs, id_col, text_col, **options)
    return docs.where(scorer(spark, weights, bias)(F.col(text_col).cast("string")) >= min_score)
