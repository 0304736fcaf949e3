"""Operator 2: language-model scores by online logistic context mixing.

The model (``context_mixing``) is a fixed-size table of bit predictors over hashed contexts,
counted over every learning document. Each task counts its documents into one table and
emits it in compressed parts; the parts are summed as streams, part by part. The starting
weights of the mixer are fitted on a fold of the learning documents (1/32) with the counts
of the other documents; the counts of all of them make the final model. Its size is
``K * 2**bits`` bytes (20 MiB by default) whatever the input, which bounds the broadcast.

Beside it stands a word baseline (add-half unigram). Token counts are shuffled by a 64-bit
hash. The tokens that make up at least 1/hot_tokens of all training tokens are at most
``hot_tokens`` by counting and are broadcast; only the others are joined, so no join key
holds more than that share of the training tokens.

Null texts count as empty; repeated rows are scored each; an empty table gives no rows.
Columns other than the three named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import context_mixing as cm
from tessera.llm.common import materialise, parallelism, prepare

BITS = 22
PART = 1 << 16
HOT_TOKENS = 1 << 19
FOLD = 32
END = np.int64(0x1E3779B97F4A7C15)  # stands for the token that closes a text
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 18
LAID_ASIDE = 8 << 20
TOKENS = 2_000_000  # distinct tokens of blocks that a counting task holds before it merges them

COUNTED = "kind int, a long, n long, cells binary"
SCORED = ("rid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, hot_known long, hot_log double, bits double, "
          "rare array<long>, rare_n array<int>")


def blocks(texts: list[bytes], size: int = BLOCK):
    """(first, last) index ranges of consecutive texts of about ``size`` bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every token of the texts, in order, and the index of its text; without the closing token."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.flatnonzero(~space)
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - start
    off = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    term = (buf[word].astype(np.uint64) + np.uint64(1)) * cm.POWERS[off & (cm.SMALL - 1)] * (2 * (off >> 15) + 1).astype(np.uint64)
    h = np.add.reduceat(term, np.cumsum(size) - size)
    h = (h ^ (h >> np.uint64(31))) * cm.MIX2
    h = (h ^ (h >> np.uint64(29)) ^ size.astype(np.uint64)) * cm.MIX
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return (h ^ (h >> np.uint64(32))).view(np.int64), np.searchsorted(np.cumsum(lens), start - 1, side="right")


def _table_rows(table: np.ndarray, kind: int):
    press = zstandard.ZstdCompressor(level=1)
    parts = table.shape[1] // PART
    for k in range(cm.K):
        for p in range(parts):
            cells = table[k, p * PART:(p + 1) * PART]
            if cells.any():
                yield kind, k * parts + p, 0, press.compress(cells.tobytes())


class TokenCounts:
    """Token hashes and their counts, merged when many have come together."""

    def __init__(self):
        self.hashes, self.counts, self.held = [], [], 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.held += len(hashes)

    def merge(self) -> int:
        """Sum the counts of equal hashes; how many there are."""
        if len(self.hashes) > 1:
            h, n = np.concatenate(self.hashes), np.concatenate(self.counts)
            by = np.argsort(h)
            h = h[by]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            self.hashes, self.counts = [h[new]], [np.add.reduceat(n[by], new)]
        self.held = sum(map(len, self.hashes))
        return self.held

    def batches(self, schema: pa.Schema):
        if self.merge():
            u, n = self.hashes[0], self.counts[0]
            for i in range(0, len(u), 1 << 16):
                part = u[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), pa.array(part), pa.array(n[i:i + (1 << 16)]),
                                                  pa.nulls(len(part), pa.binary())], schema=schema)
        self.__init__()


def _count_task(bits: int):
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])

    def rows(it):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*it), schema.types)], schema=schema)

    def run(batches):
        table = np.zeros((cm.K, 1 << bits), np.uint32)
        aside: list[bytes] = []
        held = 0
        tokens = TokenCounts()
        for batch in batches:
            texts = [(t or b"").lower() for t in batch.column("text").to_pylist()]
            fold = batch.column("fold").to_pylist()
            for i, j in blocks(texts):
                h, _ = token_hashes(texts[i:j])
                u, n = np.unique(h, return_counts=True)
                tokens.add(np.append(u, END), np.append(n, j - i).astype(np.int64))
                if tokens.held > TOKENS and tokens.merge() > TOKENS // 2:
                    yield from tokens.batches(schema)
                count = [t for t, f in zip(texts[i:j], fold[i:j]) if not f]
                if count:
                    cm.count(count, table)
            mine = [t for t, f in zip(texts, fold) if f]
            if mine:
                yield rows([(3, 0, 0, t) for t in mine])
                aside += mine
                held += sum(map(len, mine))
            if held > LAID_ASIDE:
                own = np.zeros_like(table)
                for i, j in blocks(aside):
                    cm.count(aside[i:j], own)
                for r in _table_rows(own, 2):
                    yield rows([r])
                aside, held = [], 0
                del own
        yield from tokens.batches(schema)
        for r in _table_rows(table, 1):
            yield rows([r])
        if aside:
            table[:] = 0
            for i, j in blocks(aside):
                cm.count(aside[i:j], table)
            for r in _table_rows(table, 2):
                yield rows([r])

    return run


def _sum_parts(batches):
    """Partitions sorted by part: sums the compressed counts of each part as they stream by."""
    schema = pa.schema([("a", pa.int64()), ("fitted", pa.binary()), ("full", pa.binary())])
    unpress = zstandard.ZstdDecompressor()
    at, both, first = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([cm.finish(first).tobytes()]), pa.array([cm.finish(both).tobytes()])],
                                          schema=schema)

    for batch in batches:
        for kind, a, cells in zip(batch.column("kind").to_pylist(), batch.column("a").to_pylist(), batch.column("cells")):
            if a != at:
                if at is not None:
                    yield done()
                at, both, first = a, np.zeros(PART, np.uint64), np.zeros(PART, np.uint64)
            c = np.frombuffer(unpress.decompress(cells.as_buffer()), np.uint32)
            both += c
            if kind == 1:
                first += c
    if at is not None:
        yield done()


def _model(parts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The model without and with the fold's counts. ``parts`` has at most K * 2**bits / PART rows."""
    empty = cm.finish(np.zeros(16))
    fitted, full = (np.tile(empty, (cm.K, (1 << bits) // 16)) for _ in range(2))
    got = parts.toArrow()
    per = (1 << bits) // PART
    for a, x, y in zip(got["a"].to_pylist(), got["fitted"].to_pylist(), got["full"].to_pylist()):
        k, p = divmod(a, per)
        fitted[k, p * PART:(p + 1) * PART] = np.frombuffer(x, np.int8)
        full[k, p * PART:(p + 1) * PART] = np.frombuffer(y, np.int8)
    return fitted, full


def _fit_task(shared, passes=(0.02, 0.01, 0.005)):
    schema = pa.schema([("at", pa.int32()), ("w", pa.float64()), ("n", pa.float64())])

    def run(batches):
        w = cm.start_weights()
        n = 0
        for batch in batches:
            texts = batch.column("cells").to_pylist()
            for i, j in blocks(texts):
                for rate in passes:
                    _, out = cm.score(texts[i:j], shared.value, w, rate, shared=True)
                    w = out[0]
                n += sum(map(len, texts[i:j])) + j - i
        if n:
            flat = w.reshape(-1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * n),
                                              pa.array(np.full(len(flat), float(n)))], schema=schema)

    return run


def _score_task(shared, hot, rate: float):
    def run(batches):
        model, weights = shared.value
        keys, logs = hot.value
        for batch in batches:
            texts = [(t or b"").lower() for t in batch.column("text").to_pylist()]
            out = []
            for i, j in blocks(texts):
                cost, _ = cm.score(texts[i:j], model, weights, rate)
                h, owner = token_hashes(texts[i:j])
                h = np.append(h, np.full(j - i, END))
                owner = np.append(owner, np.arange(j - i))
                tokens = np.bincount(owner, minlength=j - i)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                known = np.bincount(owner[found], minlength=j - i)
                log = np.bincount(owner[found], weights=logs[at[found]], minlength=j - i)
                pair = np.stack([owner[~found], h[~found]], axis=1)
                by = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[by]
                new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]).any(axis=1)]) if len(pair) else np.empty(0, np.int64)
                times = np.diff(np.r_[new, len(pair)]).astype(np.int32)
                ends = np.r_[0, np.cumsum(np.bincount(pair[new, 0], minlength=j - i))].astype(np.int32)
                out.append(pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in ("rid", "doc_id", "held_out")]
                    + [pa.array([len(t) + 1 for t in texts[i:j]], pa.int64()), pa.array(tokens), pa.array(known), pa.array(log), pa.array(cost),
                       pa.ListArray.from_arrays(ends, pa.array(pair[new, 1])), pa.ListArray.from_arrays(ends, pa.array(times))],
                    names=["rid", "doc_id", "held_out", "n_bytes", "n_tokens", "hot_known", "hot_log", "bits", "rare", "rare_n"]))
            yield from out

    return run


def score_documents(docs: DataFrame, learn: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text",
                    bits: int = BITS, hot_tokens: int = HOT_TOKENS, rate: float = cm.RATE) -> DataFrame:
    """Scores of all texts by a model learnt from the rows where ``learn`` holds.

    ``fold`` picks the learning rows on which the starting weights are fitted. Returns
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte``:
    ``score`` is the log10 probability of the lower-cased text with its end, ``base_score``
    that of its tokens with their end under the add-half word model, ``bits_per_byte`` the cost per byte of the text with
    its end. A very long text is scored whole, a chunk at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"),
                      F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(fold, F.lit(False)).alias("fold"))
    counted = materialise(src.where("learn").select("text", "fold").mapInArrow(_count_task(bits), COUNTED), "counted")

    vocabulary = materialise(counted.where("kind = 0").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("c")), "tokens")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = int(total.n), int(total.v)
    frequent = vocabulary.where(F.col("c") * hot_tokens >= train_tokens).toArrow()
    keys, c = frequent["token"].to_numpy(), frequent["c"].to_numpy()
    by = np.argsort(keys)
    hot = sc.broadcast((keys[by], np.log10(c[by] + 0.5)))

    parts = (counted.where("kind in (1, 2)").select("kind", "a", "cells").repartition(parallelism(spark), "a")
             .sortWithinPartitions("a").mapInArrow(_sum_parts, "a long, fitted binary, full binary"))
    fitted, full = _model(parts, bits)
    fit = sc.broadcast(fitted)
    sums = (counted.where("kind = 3").select("cells").mapInArrow(_fit_task(fit), "at int, w double, n double")
            .groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).collect())
    weights = cm.start_weights()
    for r in sums:
        weights.reshape(-1)[r["at"]] = r["w"]
    fit.unpersist()

    numbered = src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (~F.col("learn")).alias("held_out"), "text")
    scored = materialise(numbered.mapInArrow(_score_task(sc.broadcast((full, weights)), hot, rate), SCORED), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select(
        "rid", F.col("x.rare").alias("token"), F.col("x.rare_n").alias("n"))
    found = rare.join(vocabulary, "token", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))).alias("log"))
    base_of = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return scored.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(base_of)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"), "bits", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
