"""Operator 3: SentencePiece encoding with seeded merge dropout, and its exact decoding.

The vocabulary is that of a SentencePiece BPE model with byte fallback; the file is read on
the driver and shipped (its size is the vocabulary's). Encoding merges neighbouring symbols
by an agenda of candidates, highest score first and leftmost among equals. A candidate that
comes up is skipped for good if a keyed hash of (seed, row, number of the unit in the text,
unit, span) falls under the dropout rate, so a row is cut alike on every run and retry.

A text is cut into units that no piece crosses (spaces and the signs after them, line ends);
a unit's pieces depend on which of its spans are dropped. For each unit a bounded cache keeps its pieces
without dropout and the spans these merge. Those spans are drawn for every unit of
every text; only where one is dropped is the unit's agenda run again, with all draws of its own. The key of a row (``variant``) is a 64-bit hash of its id and text: copies in different
rows are segmented differently. Decoding gives back exactly the text: a sign U+2581 in the
text, which pieces use for the space, is written as bytes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
MARK = "▁"
CACHE_UNITS = 200_000
BLOCK_UNITS = 200_000
LONG_TEXT = 1 << 20  # signs of a text whose units are taken one by one
SHORT_UNIT = 40  # longer units are merged each time
NONE = 1 << 40
UNITS = re.compile(f" *[^ \\n{MARK}]+| +|\\n|{MARK}")
MASK = (1 << 64) - 1
OUT = "doc_id long, ids array<int>, n_pieces long, n_bytes long, variant long, lossless boolean"


class Vocabulary:
    """Pieces and scores of a model, as plain tables."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], size: int):
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.cost = {p: -score for p, (_, score) in pieces.items() if len(p) > 1}
        self.byte_ids = byte_ids
        self.spelt = [b""] * size
        for p, (i, _) in pieces.items():
            self.spelt[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.spelt[i] = bytes([b])
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many units at once: sign -> symbol, and pairs of symbols -> (rank, symbol).

        A symbol is a piece id; a sign that only occurs inside pieces gets a number after them.
        """
        symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbol.setdefault(c, len(self.spelt) + len(symbol) - len(self.ids))
        self.sign = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.sign[ord(c)] = i
        order = {cost: r for r, cost in enumerate(sorted(set(self.cost.values())))}
        pairs = {}
        for p, cost in self.cost.items():
            for cut in range(1, len(p)):
                left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[cost], self.ids[p])
        keys = np.array(sorted(pairs), np.int64)
        self.pair = np.append(keys, np.iinfo(np.int64).max)
        self.rank = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [-1], np.int32)


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, [0] * 256
    for i in range(m.vocab_size()):
        if m.is_byte(i):
            byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            pieces[m.id_to_piece(i)] = (i, m.get_score(i))
    return Vocabulary(pieces, byte_ids, m.vocab_size())


def _dropped(own: int, left: int, end: int, limit: int) -> bool:
    """Whether the candidate that spans signs left .. end of the unit is skipped."""
    x = ((own ^ (left * 0x9E3779B97F4A7C15 + end * 0xBF58476D1CE4E5B9)) * 0xD6E8FEB86659FD93) & MASK
    return (((x ^ (x >> 32)) * 0xBF58476D1CE4E5B9) & MASK) >> 11 < limit


def _all_dropped(own: np.ndarray, left: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    x = (own ^ (left * np.uint64(0x9E3779B97F4A7C15) + end * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11) < np.uint64(limit)


def merge_many(symbols: np.ndarray, own: np.ndarray, vocabulary: Vocabulary, limit: int,
               spans: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The agendas of many units of the same length together: every round takes the best candidate of each unit.
    ``spans`` collects what was merged, as (units' numbers, begins, ends) of every round.

    ``symbols`` [units, signs]; whether a candidate is dropped depends on its span alone, so dropped
    ones never enter. A unit leaves when its agenda is empty; the others have merged equally often.
    Returns the units' numbers and symbols, in groups of those that left together.
    """
    out = []
    live = np.arange(len(symbols))
    symbols = symbols.copy()
    n, m = symbols.shape
    start = np.tile(np.arange(m + 1, dtype=np.uint64), (n, 1))   # where each symbol begins, and the end

    def cost(left, right, begin, end, key):
        pair = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(vocabulary.pair, pair)
        at[vocabulary.pair[at] != pair] = len(vocabulary.pair) - 1
        rank = vocabulary.rank[at]
        if limit:  # only what could merge is drawn
            can = np.flatnonzero(rank != NONE)
            rank[can[_all_dropped(key[can], begin[can], end[can], limit)]] = NONE
        return rank, vocabulary.merged[at]

    shape = (n, m - 1)
    agenda, becomes = (x.reshape(shape) for x in cost(symbols[:, :-1].ravel(), symbols[:, 1:].ravel(), start[:, :-2].ravel(),
                                                      start[:, 2:].ravel(), np.repeat(own, m - 1)))
    while len(live):
        if not agenda.shape[1]:
            out.append((live, symbols))
            break
        best = agenda.argmin(axis=1)
        done = agenda[np.arange(len(live)), best] == NONE
        if done.any():
            out.append((live[done], symbols[done]))
            go = ~done
            live, own, symbols, start, agenda, becomes, best = (x[go] for x in (live, own, symbols, start, agenda, becomes, best))
            if not len(live):
                break
        rows = np.arange(len(live))
        m = symbols.shape[1]
        made = becomes[rows, best]
        if spans is not None:
            spans.append((live, start[rows, best], start[rows, best + 2]))

        def without(x, at):                                     # each row without its cell ``at``
            keep = np.arange(x.shape[1]) != at[:, None]
            return x[keep].reshape(len(x), x.shape[1] - 1)

        symbols, start = without(symbols, best + 1), without(start, best + 1)
        agenda, becomes = without(agenda, best), without(becomes, best)
        symbols[rows, best] = made
        for side in (best - 1, best):                           # the pairs that hold the new symbol
            some = np.flatnonzero((side >= 0) & (side < m - 2))
            i, k = some, side[some]
            agenda[i, k], becomes[i, k] = cost(symbols[i, k], symbols[i, k + 1], start[i, k], start[i, k + 2], own[i])
    return out


def merge_short(symbols: list[str], score: dict[str, float], own: int, limit: int) -> list[str]:
    """The agenda as a list with the cost of merging each symbol with the next: best for short units."""
    none = float("inf")
    get = score.get
    agenda = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
    starts = list(range(len(symbols)))
    while agenda:
        best = min(agenda)
        if best == none:
            break
        i = agenda.index(best)
        pair = symbols[i] + symbols[i + 1]
        if limit and _dropped(own, starts[i], starts[i] + len(pair), limit):
            agenda[i] = none
            continue
        symbols[i] = pair
        del symbols[i + 1], starts[i + 1], agenda[i]
        if i < len(agenda):
            agenda[i] = get(pair + symbols[i + 1], none)
        if i:
            agenda[i - 1] = get(symbols[i - 1] + pair, none)
    return symbols


def merge_long(symbols: list[str], score: dict[str, float], own: int, limit: int) -> list[str]:
    """The same with a heap and a linked list, for units of many signs."""
    n = len(symbols)
    live: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right < n:
            pair = live[left] + live[right]
            cost = score.get(pair)
            if cost is not None:
                heapq.heappush(heap, (cost, left, right, len(pair)))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, left, right, size = heapq.heappop(heap)
        if live[left] is None or live[right] is None or after[left] != right or len(live[left]) + len(live[right]) != size:
            continue  # one of the two has merged meanwhile
        if limit and _dropped(own, left, left + size, limit):
            continue
        live[left] += live[right]
        live[right] = None
        after[left] = after[right]
        if after[right] < n:
            before[after[right]] = left
        offer(before[left], left)
        offer(left, after[left])
    return [s for s in live if s is not None]


def encode_unit(unit: str, vocabulary: Vocabulary, own: int, dropout: float) -> array:
    """Piece ids of one unit. ``own`` decides which candidates are dropped."""
    if unit == MARK:
        return array("i", [vocabulary.byte_ids[b] for b in MARK.encode()])
    merge = merge_short if len(unit) <= SHORT_UNIT else merge_long
    ids = vocabulary.ids
    out = array("i")
    for s in merge(list(unit.replace(" ", MARK)), vocabulary.cost, own, int(dropout * (1 << 53))):
        i = ids.get(s)
        if i is None:
            out.extend([vocabulary.byte_ids[b] for b in s.encode()])
        else:
            out.append(i)
    return out


def free_spans(unit: str, cost: dict[str, float]) -> list[tuple[int, int]]:
    """The spans that merge without dropout, in their order."""
    symbols, starts, free = list(unit), list(range(len(unit))), []
    none = float("inf")
    while len(symbols) > 1:
        agenda = [cost.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        best = min(agenda)
        if best == none:
            break
        i = agenda.index(best)
        symbols[i] += symbols[i + 1]
        del symbols[i + 1], starts[i + 1]
        free.append((starts[i], starts[i] + len(symbols[i])))
    return free


class Encoder:
    """Units seen last, with their pieces without dropout and the spans that these merge.

    A unit is cut like that unless one of those spans is dropped; only then is it merged under its own draws. At most
    ``CACHE_UNITS`` units are kept besides those of the block at hand, which are at most ``BLOCK_UNITS``.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.vocabulary, self.dropout, self.seed = vocabulary, dropout, seed
        self.limit = int(dropout * (1 << 53))
        self.clear()

    def clear(self) -> None:
        self.types: dict[str, int] = {}                 # unit -> its number
        self.plain: list[bytes] = []                    # piece ids as 32-bit numbers
        self.first, self.size, self.hash = array("q"), array("q"), array("Q")
        self.left, self.end = array("B"), array("B")

    def _learn(self, units: list[str]) -> None:
        """Number new short units and note their pieces and spans."""
        v = self.vocabulary
        plain = [b""] * len(units)
        of, left, end = [], [], []                      # every span with its unit
        for some, symbols in self._alike(units):
            merged: list = []
            for which, rows in merge_many(symbols, np.zeros(len(some), np.uint64), v, 0, merged):
                self._take(plain, some, which, rows)
            for unit, begin, to in merged:
                of.append(some[unit])
                left.append(begin)
                end.append(to)
        apart = [i for i, p in enumerate(plain) if not p]  # units with signs that are no symbols
        for i in apart:
            plain[i] = encode_unit(units[i], v, 0, 0.0).tobytes()
            free = free_spans(units[i].replace(" ", MARK), v.cost) if units[i] != MARK else []
            of.append(np.full(len(free), i))
            left.append(np.array([x for x, _ in free], np.uint64))
            end.append(np.array([x for _, x in free], np.uint64))
        owner, left, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (of, left, end))
        if apart:  # what merged before such a unit was found not to be made of pieces only
            merged_apart = np.isin(owner, apart)
            merged_apart[len(owner) - sum(len(x) for x in of[len(of) - len(apart):]):] = False
            owner, left, end = (x[~merged_apart] for x in (owner, left, end))
        by = np.argsort(owner, kind="stable")
        size = np.bincount(owner.astype(np.int64), minlength=len(units))
        at = len(self.plain)
        self.types.update(zip(units, range(at, at + len(units))))
        self.first.frombytes((len(self.left) + np.cumsum(size) - size).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.left.frombytes(left[by].astype(np.uint8).tobytes())
        self.end.frombytes(end[by].astype(np.uint8).tobytes())
        self.plain += plain
        digest = xxhash.xxh64_intdigest
        self.hash.extend([digest(u.encode()) for u in units])

    def _alike(self, units: list[str]):
        """(places, symbols) of the units of equal length whose signs all are symbols."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        signs = np.frombuffer("".join([units[i] for i in order.tolist()]).replace(" ", MARK).encode("utf-32-le"), np.uint32)
        sizes = sizes[order]
        ends = np.cumsum(sizes)
        for size in np.unique(sizes).tolist():
            if 1 < size <= SHORT_UNIT:
                a, b = np.searchsorted(sizes, [size, size + 1])
                symbols = self.vocabulary.sign[signs[ends[a] - size:ends[b - 1]]].reshape(-1, size)
                known = (symbols >= 0).all(axis=1)
                if known.any():
                    yield (order[a:b], symbols) if known.all() else (order[a:b][known], symbols[known])

    def _take(self, out: list, some: np.ndarray, which: np.ndarray, rows: np.ndarray) -> None:
        """Put the merged rows that are all pieces into ``out``."""
        width = 4 * rows.shape[1]
        raw = np.ascontiguousarray(rows, np.int32).tobytes()
        spelt = (rows < len(self.vocabulary.spelt)).all(axis=1).tolist()
        for x, (i, known) in enumerate(zip(some[which].tolist(), spelt)):
            if known:
                out[i] = raw[x * width:(x + 1) * width]

    def _touched(self, kind: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which units have a span dropped that would merge."""
        first, size = np.frombuffer(self.first, np.int64)[kind], np.frombuffer(self.size, np.int64)[kind]
        left, end = (np.frombuffer(x, np.uint8).astype(np.uint64) if len(x) else np.empty(0, np.uint64) for x in (self.left, self.end))
        hit = np.zeros(len(kind), bool)
        for a in range(0, len(kind), 1 << 17):
            n = size[a:a + (1 << 17)]
            owner = np.repeat(np.arange(len(n)), n)
            span = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:a + (1 << 17)], n)
            hit[a + owner[_all_dropped(own[a:a + (1 << 17)][owner], left[span], end[span], self.limit)]] = True
        return hit

    def _merge(self, units: list[str], own: np.ndarray) -> list[bytes]:
        """Piece ids of each unit under its own draws."""
        out: list[bytes] = [b""] * len(units)
        for some, symbols in self._alike(units):
            for which, rows in merge_many(symbols, own[some], self.vocabulary, self.limit):
                self._take(out, some, which, rows)
        return [x or encode_unit(u, self.vocabulary, int(o), self.dropout).tobytes() for x, u, o in zip(out, units, own.tolist())]

    def _encode_units(self, units: list[str], own: np.ndarray) -> list[bytes]:
        """Piece ids of each unit; ``own`` is a hash of its row and place."""
        if len(self.types) >= CACHE_UNITS:
            self.clear()
        # a unit that the block holds once is merged under its draws straight away
        new = [u for u, n in Counter(units).items() if n > 1 and u not in self.types and len(u) <= SHORT_UNIT]
        if new:
            self._learn(new)
        kind = np.fromiter(map(self.types.get, units, repeat(-1)), np.int64, len(units))
        hashes = np.frombuffer(self.hash, np.uint64)[kind] if len(self.hash) else np.zeros(len(kind), np.uint64)
        long_units = np.flatnonzero(kind < 0)
        if len(long_units):
            hashes[long_units] = [xxhash.xxh64_intdigest(units[i].encode()) for i in long_units.tolist()]
        own = (own ^ hashes) * np.uint64(0xD6E8FEB86659FD93)
        own = (own ^ (own >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        changed = kind < 0
        if self.limit and len(self.plain):
            short = np.flatnonzero(kind >= 0)
            changed[short[self._touched(kind[short], own[short])]] = True
        plain = self.plain
        pieces = [b"" if c else plain[k] for k, c in zip(kind.tolist(), changed.tolist())]
        anew = np.flatnonzero(changed)
        for i, x in zip(anew.tolist(), self._merge([units[i] for i in anew.tolist()], own[anew])):
            pieces[i] = x
        return pieces

    def encode_all(self, texts: list[str], variants: list[int]) -> list[array]:
        """Piece ids of each text; an empty text has none. At most ``BLOCK_UNITS`` units are in hand at a time."""
        out = [array("i") for _ in texts]
        rows, of, places, units = [], [], [], []

        def flush() -> None:
            sizes = np.array([len(p) for p in places], np.int64)
            place = np.concatenate([np.arange(p.start, p.stop, dtype=np.uint64) for p in places])
            own = np.repeat(np.array(rows, np.uint64), sizes) + place * np.uint64(0x9E3779B97F4A7C15)
            pieces, at = self._encode_units(units, own), 0
            for t, n in zip(of, sizes.tolist()):
                out[t].frombytes(b"".join(pieces[at:at + n]))
                at += n
            for x in (rows, of, places, units):
                x.clear()

        for t, (text, variant) in enumerate(zip(texts, variants)):
            if not text:
                continue
            row, place = xxhash.xxh64_intdigest(f"{self.seed}:{variant}".encode()), 0
            found = iter(UNITS.findall(" " + text)) if len(text) < LONG_TEXT else (m.group() for m in UNITS.finditer(" " + text))
            while part := list(islice(found, BLOCK_UNITS - len(units))):
                units += part
                rows.append(row)
                of.append(t)
                places.append(range(place, place + len(part)))
                place += len(part)
                if len(units) >= BLOCK_UNITS:
                    flush()
        if units:
            flush()
        return out

    def encode(self, text: str, variant: int = 0) -> array:
        return self.encode_all([text], [variant])[0]


_ENCODER: dict[tuple, Encoder] = {}  # one per worker process; its units are bounded


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of piece ids: spelt out, without the space that encoding put before it."""
    spelt = vocabulary.spelt
    raw = b"".join([spelt[i] for i in ids])
    return raw[1:].decode()


def text_blocks(texts: list[str | None], size: int = 1 << 20):
    """(first, last) index ranges of consecutive texts of about ``size`` signs."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size or i + 1 == len(texts):
            yield first, i + 1
            first, held = i + 1, 0


def encode_documents(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_pieces, n_bytes, variant, lossless`` for every row; ``lossless`` is whether decoding gives the text.

    A null text has null ids, n_pieces, n_bytes and lossless; an empty text has no ids. The
    variant of a row is a hash of its id (null: like the empty id) and text. Rows that repeat both
    are encoded alike, each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(model))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      variant_of(F.col(id_col), F.col(text_col), seed).alias("variant"))

    def run(batches):
        if (model, dropout, seed) not in _ENCODER:
            _ENCODER.clear()
            _ENCODER[model, dropout, seed] = Encoder(shared.value, dropout, seed)
        encoder = _ENCODER[model, dropout, seed]
        for batch in batches:
            variant = batch.column("variant").to_pylist()
            sizes, every, same, ids_sizes = [], array("i"), [], [0]
            texts = batch.column("text").to_pylist()
            for i, j in text_blocks(texts):
                for t, ids in zip(texts[i:j], encoder.encode_all([t or "" for t in texts[i:j]], variant[i:j])):
                    every.extend(ids)
                    ids_sizes.append(len(every))
                    sizes.append(None if t is None else len(t.encode()))
                    same.append(None if t is None else decode(ids, shared.value) == t)
            ends = pa.array(ids_sizes, pa.int32(), mask=np.array([s is None for s in sizes] + [False]))
            n = np.diff(ids_sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(every, np.int32) if every else np.empty(0, np.int32))),
                 pa.array(n.astype(np.int64), mask=np.array([s is None for s in sizes], bool)), pa.array(sizes, pa.int64()),
                 batch.column("variant"), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_pieces", "n_bytes", "variant", "lossless"])

    return src.mapInArrow(run, OUT)


def variant_of(key: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), text.cast("string"))


def decode_documents(encoded: DataFrame, spark: SparkSession, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """The encoded rows with a column ``text`` of the decoded texts (null ids: null)."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(model))

    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(lambda x: None if x is None else decode(x, shared.value))

    return encoded.withColumn("text", text_of(F.col(ids_col)))
