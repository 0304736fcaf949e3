"""Operator 12: token counts by heap-and-linked-list byte-pair merging.

A unit starts as one symbol per byte. Its adjacent pairs lie in a heap by (rank of the merge,
place); the lowest is popped, the two symbols become one in a linked list of symbols, and the
pairs with its new neighbours are pushed. An entry whose symbols have changed since is skipped.
The count is the initial symbols minus the merges; no piece ids are made.

The text is cut at white space, which no unit crosses and the model drops; each distinct
chunk is lower-cased, normalised and cut into units by the rules of the model file, and chunks and units
are counted once while they stay in the worker's cache, which is bounded in bytes. Chunks of common Latin
signs, where all libraries agree on case and normal form, are cut by the file's pattern
directly, all others by the public library's own rules.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import prepare

MODEL = "word_bpe_49k.json"
LIMIT = 2048
CACHE_BYTES = 64 << 20
#: Longer chunks are counted each time: they are rare and would fill the cache.
CACHED_CHARS = 64
#: About what a cached chunk takes beside its characters (key, count and slot).
ENTRY_BYTES = 160


#: Units whose count is kept.
UNITS = 250_000
#: Printable ASCII, Latin-1 and Latin Extended-A without the dotted capital I, whose small form is two signs.
COMMON = re.compile("[!-~\u00A1-\u00AC\u00AE-\u012F\u0131-\u017F]+").fullmatch


def byte_signs() -> dict[int, int]:
    """The sign that stands for a byte in byte-level models: itself if printable, else the next code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(printable)))}


SIGNS = byte_signs()


def model_path(name: str = MODEL) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols allow, always taking the lowest rank, then the leftmost place."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(agenda)
    merges = 0
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, ""
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(agenda, (r, i, a + b, symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(agenda, (r, h, symbols[h], a + b))
    return merges


class PairModel:
    """Merge ranks and text rules of a byte-level model file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        rules = Tokenizer.from_file(path)
        self.normalise, self.units = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        cuts = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.cut = regex.compile(cuts[0]).findall if len(cuts) == 1 else None
        self.counts = {}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def unit(self, unit: str) -> int:
        """Tokens of a unit, spelt in the model's signs for bytes."""
        n = self.counts.get(unit)
        if n is None:
            symbols = list(unit)
            symbols[-1] += self.end
            n = len(symbols) - count_merges(symbols, self.ranks)
            if len(unit) <= CACHED_CHARS:
                if len(self.counts) >= UNITS:
                    self.counts.clear()
                self.counts[unit] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if self.cut is not None and COMMON(text):
            units = self.cut(text.lower())
            if not text.isascii():
                units = [u.encode().decode("latin-1").translate(SIGNS) for u in units]
            return sum(map(self.unit, units))
        return sum(self.unit(u) for u, _ in self.units(self.normalise(text)))

    def chunk(self, text: str) -> int:
        """Tokens of a chunk; a special string in it is one token, as the library takes it by default."""
        if self.special is None or "<" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


@lru_cache(maxsize=2)
def load_model(path: str) -> PairModel:
    return PairModel(path)


class ChunkCounts(dict):
    """Counts of the chunks seen last, bounded in bytes; a missing chunk is counted."""

    def __init__(self, model: PairModel, max_bytes: int):
        super().__init__()
        self.model, self.max_bytes, self.held = model, max_bytes, 0

    def __missing__(self, chunk: str) -> int:
        n = self.model.chunk(chunk)
        if len(chunk) <= CACHED_CHARS:
            size = ENTRY_BYTES + 4 * len(chunk)
            if self.held + size > self.max_bytes:
                self.clear()
                self.held = 0
            self[chunk] = n
            self.held += size
        return n


#: White space on which Python and the model file agree; Python's four separators (0x1C-0x1F) are signs to the model.
SPACES = re.compile(r"[\x20\x09-\x0D]+")
SEPARATORS = re.compile(r"[\x1c-\x1f]").search
SPAN = 1 << 20


def spans(text: str) -> Iterator[list[str]]:
    """The chunks of a text, about SPAN characters at a time."""
    start, n = 0, len(text)
    while start < n:
        cut = n
        if n - start > SPAN:
            found = SPACES.search(text, start + SPAN)
            cut = found.end() if found else n
        part = text if cut - start == n else text[start:cut]
        yield [c for c in SPACES.split(part) if c] if SEPARATORS(part) else part.split()
        start = cut


_COUNTS: dict[tuple, ChunkCounts] = {}  # one per worker process and model, bounded in bytes


def token_counter(path: str | None, cache_bytes: int = CACHE_BYTES):
    """Column function: text -> number of tokens. Model and cache are kept once per worker process."""
    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        where = (path or model_path(), cache_bytes)
        if where not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[where] = ChunkCounts(load_model(where[0]), cache_bytes)
        counts = _COUNTS[where]
        count = counts.__getitem__
        for texts in batches:
            yield pd.Series([sum(sum(map(count, chunks)) for chunks in spans(t)) for t in texts], dtype="int64")

    return tokens


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``n_bytes`` is the text's UTF-8 length, ``n_tokens`` what the model file at ``path`` gives without
    begin or end marks and without truncation, ``over_limit`` whether it is more than ``limit``. Null and
    empty texts have 0 bytes and 0 tokens; a very long text is counted whole, a span of it at a time; a
    chunk without white space takes time n log n in its length. Repeated rows and rows without an id
    are counted like any others; an empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_counter(path)(text).alias("n_tokens")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
