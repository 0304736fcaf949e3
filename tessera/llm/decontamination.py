"""Operator 1: benchmark decontamination by the q-gram lemma over diagonal bands.

Texts are compared as lower-cased characters with every run of other signs as one space.
A benchmark item is cut into overlapping windows of ``window`` characters (a shorter item is
one window), which start at most a budget's edits and one apart: a passage that lies between
two windows is within the budget of one. A window leaks into a document if some part of the
document is within ``budget(window length)`` edits of it. By the q-gram lemma such a part shares at least
``length - q + 1 - budget * q`` q-grams with the window, on diagonals at most ``budget``
apart. So shared q-grams are counted per window and diagonal band; the bands are
``2 * budget + 2`` wide and overlap by half, so every run of ``budget + 1`` diagonals lies
in one band. Bands that reach the bound are verified by a banded alignment.

For copies with replaced words there are wide windows besides: the whole item, or parts of
``wide`` characters that overlap by half. A wide window leaks if a part of the document is
within ``wide_share`` of its length in edits and shares an eighth of its q-grams with it on
one band; the lemma gives no bound there, so the shared q-grams belong to the rule.

The index holds every q-gram of an item once with its place. Shared q-grams are counted per
item and band first, and per window only where the item has enough of them.

The documents are read once per block of benchmark items; a block holds at most
``block_chars`` characters (so what is broadcast is bounded), and a benchmark within one
block costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import prepare

Q = 12
WINDOW = 72
STRIDE = 4
ERROR_SHARE = 0.05
WIDE = 512
WIDE_SHARE = 0.15
MIN_CHARS = 24
BLOCK_CHARS = 8_000_000
BITMAP_BITS = 22
GROUP_CHARS = 1 << 18
FIELDS = ("item_id", "window_start", "doc_start", "doc_end", "edits", "shared")
PRIME = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32

HIT = "item_id long, window_start int, doc_start int, doc_end int, edits int, shared int"
HITS = f"array<struct<{HIT.replace(' long', ': bigint').replace(' int', ': int')}>>"


def _fold_table() -> np.ndarray:
    """Character folding of the basic plane: lower case for letters and digits, a space for the rest."""
    out = np.full(1 << 16, SPACE, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_FOLD: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """The text as code points: folded, runs of spaces as one, none at the ends."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 1 << 16, _FOLD[0][np.minimum(c, (1 << 16) - 1)], c)
    keep = c != SPACE
    if len(c) > 1:
        keep[1:] |= c[:-1] != SPACE  # the first space of a run
    c = c[keep]
    if len(c) and c[0] == SPACE:
        c = c[1:]
    return c[:-1] if len(c) and c[-1] == SPACE else c


def spelt(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def qgram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each position (len - q + 1 of them), by doubling."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, size, power, out, at = c.astype(np.uint64) + np.uint64(1), 1, np.array([PRIME]), None, 0
    left = q
    while left:
        if left & 1:  # append this power of two to what is there
            part = h[at:at + n]
            out = part.copy() if out is None else out * power + part
            at += size
        left >>= 1
        if left:
            h = h[:-size] * power + h[size:]
            size, power = size * 2, np.multiply(power, power, dtype=np.uint64)
    out ^= out >> np.uint64(32)
    out *= PRIME
    return out


def budget_of(length: int, share: float = ERROR_SHARE, q: int = Q) -> int:
    """The edits allowed: a share of the length, and so few that the lemma's bound stays above zero."""
    return max(0, min(int(share * length), (length - q) // q))


class Windows:
    """The windows of all items of one kind: ``count`` windows of ``length`` characters an item, ``stride`` apart, the last at the item's end."""

    def __init__(self, sizes: np.ndarray, window: int, stride: int, q: int, budget, need):
        self.stride = stride
        self.length = np.minimum(sizes, window)
        self.last = sizes - self.length
        self.count = -(-self.last // stride) + 1
        self.first = np.cumsum(self.count) - self.count
        self.budget = np.array([budget(int(n)) for n in self.length], np.int64)
        grams = self.length - q + 1
        self.need = np.array([need(int(n), int(e)) for n, e in zip(grams, self.budget)], np.int64)
        self.reach = grams - 1                                  # from a window's start to its last q-gram

    def start(self, item: np.ndarray, number: np.ndarray) -> np.ndarray:
        return np.minimum(number * self.stride, self.last[item])


class Index:
    """The q-grams of one block of benchmark items with their places, sorted by hash, and the items' windows."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, stride: int, share: float, min_chars: int,
                 wide: int = 0, wide_share: float = 0.0):
        self.q = q
        self.ids: list[int] = []
        folds, hashes, owners, offsets = [], [], [], []
        short: dict[str, list[int]] = {}
        for item, text in items:
            c = folded(text)
            if len(c) < max(min_chars, q):
                if len(c):
                    short.setdefault(f" {spelt(c)} ", []).append(item)
                continue
            h = qgram_hashes(c, q)
            owners.append(np.full(len(h), len(self.ids), np.int32))
            offsets.append(np.arange(len(h), dtype=np.int32))
            hashes.append(h)
            self.ids.append(item)
            folds.append(c)
        self.short = ahocorasick.Automaton()
        for run, ids in short.items():
            self.short.add_word(run, (len(run), ids))
        if short:
            self.short.make_automaton()
        empty = np.empty(0, np.int32)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        by = np.argsort(h, kind="stable")
        self.hash = h[by]
        self.owner = np.concatenate(owners)[by] if owners else empty
        self.offset = np.concatenate(offsets)[by] if offsets else empty
        self.signs = np.concatenate(folds) if folds else np.empty(0, np.uint32)
        sizes = np.array([len(c) for c in folds], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.kinds = [Windows(sizes, window, stride, q, lambda n: budget_of(n, share, q), lambda grams, e: grams - e * q)]
        if wide:
            self.kinds.append(Windows(sizes, wide, max(1, wide // 2), q, lambda n: int(wide_share * n),
                                      lambda grams, e: max(1, grams // 8, grams - e * q)))
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.hash >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True

    def _spread(self) -> tuple[np.ndarray, np.ndarray]:
        k = self.kinds[0]
        item = np.repeat(np.arange(len(self.ids)), k.count)
        return item, k.start(item, np.arange(len(item)) - k.first[item])

    @property
    def items(self) -> list[int]:
        """The item of each narrow window."""
        return [self.ids[i] for i in self._spread()[0].tolist()]

    @property
    def starts(self) -> list[int]:
        return self._spread()[1].tolist()

    @property
    def texts(self) -> list[np.ndarray]:
        return [self.signs[a:a + n] for a, n in zip((self.begin[self._spread()[0]] + self._spread()[1]).tolist(),
                                                    self.kinds[0].length[self._spread()[0]].tolist())]

    @property
    def budget(self) -> np.ndarray:
        return self.kinds[0].budget[self._spread()[0]]


def banded_alignments(patterns: np.ndarray, text: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits between each row of ``patterns`` [n, m] and a part of ``text`` on its diagonals first .. first + width - 1.

    Returns (edits, start, end); of parts with the fewest edits, the one that starts first.
    Cell (i, k) holds, for the first i signs of a pattern against a part that ends before
    sign i + first + k of the text, edits * 2**32 + start; all pairs take each row together.
    """
    n, m = patterns.shape
    k = np.arange(width)
    one = np.int64(1) << 32
    at = first[:, None] + k
    row = at + (np.int64(1) << 30)                              # no edit; starts may be negative, so they are shifted
    for i in range(1, m + 1):
        sign = text[np.clip(at + (i - 1), 0, len(text) - 1)]
        new = row + (sign != patterns[:, i - 1:i]) * one
        np.minimum(new[:, :-1], row[:, 1:] + one, out=new[:, :-1])  # a sign of the pattern is missing in the text
        row = np.minimum.accumulate(new - k * one, axis=1) + k * one  # a sign of the text is left over
    best = np.argmin(row, axis=1)
    value = row[np.arange(n), best]
    return value >> 32, (value & (one - 1)) - (np.int64(1) << 30), m + first + best


def find_windows(texts: list[str | None], index: Index) -> list[list[tuple]]:
    """For each text the verified windows: (item_id, window_start, start, end, edits, shared)."""
    folds = [folded(t) if t else np.empty(0, np.uint32) for t in texts]
    out = [_short_runs(c, index) for c in folds]
    if len(index.hash):
        _long_windows(folds, index, out)
    for hits in out:
        hits.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    return out


def _short_runs(c: np.ndarray, index: Index) -> list[tuple]:
    """Items too short for a window, where they stand as whole words."""
    if not len(index.short) or not len(c):
        return []
    return [(item, 0, end + 1 - size, end - 1, 0, 0) for end, (size, ids) in index.short.iter(f" {spelt(c)} ") for item in ids]


def _long_windows(folds: list[np.ndarray], index: Index, out: list[list[tuple]]) -> None:
    """Adds the verified windows of each folded text."""
    gap = np.zeros(max(int(k.budget.max()) for k in index.kinds) + 2, np.uint32)  # costs more than any budget to cross
    sizes = np.array([len(c) + len(gap) for c in folds], np.int64)
    starts = np.cumsum(sizes) - sizes
    c = np.concatenate([x for f in folds for x in (f, gap)]) if folds else np.empty(0, np.uint32)
    h = qgram_hashes(c, index.q)
    at = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
    lo = np.searchsorted(index.hash, h[at], side="left")
    n = np.searchsorted(index.hash, h[at], side="right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return
    post = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    item, offset = index.owner[post].astype(np.int64), index.offset[post].astype(np.int64)
    doc = np.repeat(np.searchsorted(starts, at, side="right") - 1, n)
    diagonal = np.repeat(at, n) - starts[doc] - offset
    for kind in index.kinds:
        found: dict[tuple, tuple] = {}
        doc_of, item_of, start_of, band, shared = _candidates(kind, doc, item, offset, diagonal)
        sizes_of, budget_of_item = kind.length[item_of], kind.budget[item_of]
        for m, budget in sorted(set(zip(sizes_of.tolist(), budget_of_item.tolist()))):
            some = np.flatnonzero((sizes_of == m) & (budget_of_item == budget))
            for a in range(0, len(some), 4096):
                part = some[a:a + 4096]
                patterns = index.signs[(index.begin[item_of[part]] + start_of[part])[:, None] + np.arange(m)]
                first = starts[doc_of[part]] + start_of[part] + band[part] * (budget + 1)
                edits, start, end = banded_alignments(patterns, c, first, 2 * (budget + 1))
                for x in np.flatnonzero(edits <= budget):
                    y = part[x]
                    d, i, w = int(doc_of[y]), int(item_of[y]), int(start_of[y])
                    s, e = max(0, int(start[x] - starts[d])), min(len(folds[d]), int(end[x] - starts[d]))
                    hit = (index.ids[i], w, s, e, int(edits[x]), int(shared[y]))
                    old = found.get((d, i, w, e))
                    if old is None or (hit[4], -hit[5]) < (old[4], -old[5]):
                        found[d, i, w, e] = hit
        for (d, *_), hit in found.items():
            out[d].append(hit)


def _candidates(kind: Windows, doc: np.ndarray, item: np.ndarray, offset: np.ndarray, diagonal: np.ndarray):
    """The (document, item, window start, band, shared q-grams) that reach the bound of their window."""
    band = diagonal // (kind.budget[item] + 1)
    # a band is two half bands wide: a q-gram counts in the band that starts at its half and in the one before
    item, offset, doc = np.concatenate([item, item]), np.concatenate([offset, offset]), np.concatenate([doc, doc])
    band = np.concatenate([band, band - 1])
    by = np.lexsort((offset, band, item, doc))
    item, band, offset, doc = item[by], band[by], offset[by], doc[by]
    new = np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (doc[1:] != doc[:-1])]
    fresh = new | np.r_[True, offset[1:] != offset[:-1]]       # each q-gram of the item once per band
    item, band, offset, doc, new = item[fresh], band[fresh], offset[fresh], doc[fresh], new[fresh]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(item)])
    enough = size >= kind.need[item[first]]                    # no window has more than its item
    first, size = first[enough], size[enough]
    # the windows that hold a shared q-gram of a group, from its first to its last
    own = item[first]
    low = -(-np.maximum(offset[first] - kind.reach[own], 0) // kind.stride)
    end = offset[first + size - 1]
    high = np.where(end >= kind.last[own], kind.count[own] - 1, end // kind.stride)
    many = np.maximum(high - low + 1, 0)
    group = np.repeat(np.arange(len(first)), many)
    number = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many) + low[group]
    start = kind.start(own[group], number)
    # offsets of all groups as one rising sequence, so that one search counts those inside each window
    keep = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    rising = np.repeat(np.arange(len(first), dtype=np.int64) << 32, size) + offset[keep]
    base = group.astype(np.int64) << 32
    shared = (np.searchsorted(rising, base + start + kind.reach[own[group]], side="right")
              - np.searchsorted(rising, base + start, side="left"))
    hit = shared >= kind.need[own[group]]
    group, start, shared = group[hit], start[hit], shared[hit]
    return doc[first[group]], own[group], start, band[first[group]], shared


def leak_finder(spark: SparkSession, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, stride: int = STRIDE,
                share: float = ERROR_SHARE, min_chars: int = MIN_CHARS, wide: int = WIDE, wide_share: float = WIDE_SHARE):
    """Column function: text -> array of the verified windows of ``items`` in it."""
    shared = spark.sparkContext.broadcast(Index(items, q, window, stride, share, min_chars, wide, wide_share))

    @F.pandas_udf(HITS)
    def leaks(text: pd.Series) -> pd.Series:
        texts = list(text)
        out, at, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t) if t else 0
            if held >= GROUP_CHARS or i + 1 == len(texts):
                for hits in find_windows(texts[at:i + 1], shared.value):
                    out.append([dict(zip(FIELDS, x)) for x in hits])
                at, held = i + 1, 0
        return pd.Series(out, dtype=object)

    return leaks


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                     block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct items in blocks of about ``block_chars`` characters (null texts left out; an empty benchmark: none)."""
    src = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"),
                                                              F.col(text_col).cast("string").alias("text")).distinct()
    total = src.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = -(-int(total) // block_chars)
    for b in range(blocks):
        part = src if blocks == 1 else src.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each (document, item, window) that leaks: ``doc_id, item_id, window_start, doc_start, doc_end,
    edits, shared`` (positions in the folded texts).

    Null and empty texts leak nothing; items shorter than ``min_chars`` folded characters are found where they
    stand unchanged as whole words (window 0, no edits, no shared q-grams), items without a letter or digit nowhere;
    a very long text is searched whole; repeated rows are reported each, repeated items once; an empty
    table gives no rows. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    block_chars = options.pop("block_chars", BLOCK_CHARS)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in benchmark_blocks(benchmark, block_chars=block_chars):
        leaks = leak_finder(spark, items, **options)
        part = src.select("doc_id", F.explode(leaks("text")).alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        id_type = dict(src.dtypes)["doc_id"]
        return spark.createDataFrame([], f"doc_id {id_type}, {HIT}")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows in which no window of the benchmark is found, all columns kept: null and empty texts, too; repeated rows each;
    of an empty table none."""
    spark = docs.sparkSession
    prepare(spark)
    block_chars = options.pop("block_chars", BLOCK_CHARS)
    keep: Column = F.lit(True)
    for items in benchmark_blocks(benchmark, block_chars=block_chars):
        keep = keep & (F.size(leak_finder(spark, items, **options)(F.col(text_col).cast("string"))) == 0)
    return docs.where(keep)
