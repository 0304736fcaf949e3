"""Exact-size seeded splits, caps and batches.

Splits order rows by ``md5("<seed>:<key>")`` (ties by key) and cut at an exact
size. The cut point is found from hash-prefix histograms (at most 65,536 rows
each, collected), refined level by level until the cut bucket is small; the
cut row itself comes from a bounded top-k. Labelling is then a projection that
compares each row with the cut: no shuffle and no global sort of the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.plans.physical import dense_row_number

BUCKET_HEX = 4  # 16-bit buckets per level
FINAL_ROWS = 100_000  # the cut bucket is ranked exactly once it holds at most this many rows


def order_hash(key, seed: int, *salt) -> Column:
    parts = [F.lit(str(seed)), *[F.lit(str(s)) for s in salt], F.col(key).cast("string") if isinstance(key, str) else key.cast("string")]
    return F.md5(F.concat_ws(":", *parts))


def train_first_size(ratio: float = 0.9):
    """``int(n * ratio)`` rows go first."""
    return lambda n: int(n * ratio)


def val_first_size(ratio: float = 0.9):
    """``int(n * (1 - ratio))`` rows go first, in floating point (n=10 gives 0)."""
    return lambda n: int(n * (1.0 - ratio))


def ceil_share_size(test_share: float = 0.1):
    """``ceil(test_share * n)`` rows go first (the test part)."""
    return lambda n: int(math.ceil(test_share * n))


def _histogram(df: DataFrame, h: str, prefix: str) -> list[tuple[str, int]]:
    """Row counts per next 16-bit hash bucket under ``prefix`` (at most 65,536 rows)."""
    scope = df.where(F.col(h).startswith(prefix)) if prefix else df
    bucket = F.substring(F.col(h), len(prefix) + 1, BUCKET_HEX)
    return sorted((r[0], r[1]) for r in scope.groupBy(bucket.alias("b")).count().collect())


def cut_point(df: DataFrame, h: str, key: str, k: int, hist: list[tuple[str, int]] | None = None) -> tuple[str, object]:
    """The k-th smallest ``(h, key)`` (1-based), from prefix histograms."""
    prefix, remaining = "", k
    while True:
        hist = hist if hist is not None else _histogram(df, h, prefix)
        for b, c in hist:
            if remaining <= c:
                prefix += b
                size = c
                break
            remaining -= c
        hist = None
        if size <= FINAL_ROWS or len(prefix) >= 32:
            break
    last = (
        df.where(F.col(h).startswith(prefix)).select(h, key).orderBy(h, key).limit(remaining)
        .agg(F.max(F.struct(F.col(h), F.col(key))).alias("m")).first().m
    )
    return last[0], last[1]


def exact_split(df: DataFrame, key: str, seed: int, size_fn, labels=("train", "validation"),
                split_col: str = "split") -> DataFrame:
    """Label exactly ``size_fn(n)`` rows ``labels[0]``, the rest ``labels[1]``.

    ``key`` must be unique. Deterministic by seed; disjoint and complete. The
    first histogram also gives ``n``, so the data is read once for it.
    """
    d = df.withColumn("_h", order_hash(key, seed))
    first = _histogram(d, "_h", "")
    n = sum(c for _, c in first)
    k = size_fn(n)
    if k <= 0:
        return d.withColumn(split_col, F.lit(labels[1])).drop("_h")
    if k >= n:
        return d.withColumn(split_col, F.lit(labels[0])).drop("_h")
    ch, ck = cut_point(d, "_h", key, k, first)
    first_part = (F.col("_h") < F.lit(ch)) | ((F.col("_h") == F.lit(ch)) & (F.col(key) <= F.lit(ck)))
    return d.withColumn(split_col, F.when(first_part, F.lit(labels[0])).otherwise(F.lit(labels[1]))).drop("_h")


def cap(df: DataFrame, order: list, k: int) -> DataFrame:
    """L1/L3: the first ``k`` rows in ``order`` (each task keeps its own top k first)."""
    return df.orderBy(*order).limit(k)


def first_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """L2: the first ``k`` rows of each group; planned with a partial group limit before the
    shuffle, so a hot group ships at most ``k`` rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def batches(df: DataFrame, order: list, size: int, batch_col: str = "batch_id", row_col: str = "row_no") -> DataFrame:
    """``batch_id = floor(row_no / size)`` in ``order``."""
    r = dense_row_number(df, order, row_col)
    return r.withColumn(batch_col, F.floor(F.col(row_col) / F.lit(size)).cast("long"))


def epoch_batches(df: DataFrame, key: str, seed: int, epochs: int, size: int) -> DataFrame:
    """A fresh seeded order per epoch (``md5(seed:epoch:key)``), batch ids from it."""
    n = df.count()
    salted = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")))
    allx = df.select(F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch"), key).withColumn("_h", salted)
    r = dense_row_number(allx, ["epoch", "_h", key], "_r")
    pos = F.col("_r") - F.col("epoch") * F.lit(n)
    return r.select("epoch", key, pos.alias("row_no"), F.floor(pos / F.lit(size)).cast("long").alias("batch_id"))
