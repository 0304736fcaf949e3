"""Operator 6: near-duplicates by SimHash, with segment popcounts as a filter.

A 64-bit fingerprint is cut into 32 segments of two bits. The numbers of set bits per segment
(0, 1 or 2) embed it in a 32-dimensional grid, and the Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints. In unary code (``embed``) the
embedding is one 64-bit word, byte b of which holds the counts of segments 4b .. 4b + 3.

Range join: if the Manhattan distance is at most d, at most d of the eight bytes differ, so
the pair shares a cell in one of the C(8, d) projections on 8 - d bytes (70 for d = 4). In
every cell pairs are first held against the Manhattan bound, then against the exact
distance. Cells hold distinct fingerprints only. A crowded cell gives a spanning forest of
its links, not all pairs; a cell over ``cell_block`` fingerprints is dealt in pairs of
blocks, so no task holds more than two blocks of a cell at once.

Components of the links are found by alternating large-star and small-star steps over
tables in the shared folder; a label is the smallest fingerprint of its component.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import materialise, parallelism, prepare

SHINGLE_WORDS = 4
MAX_BITS = 4
CELL_BLOCK = 50_000
SMALL_CELL = 16
ODD = 0x5555555555555555
EMPTY = 0


def text_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of the text's lower-cased words."""
    split = (text or "").encode().lower().split()  # bytes.split: exactly space and 0x09-0x0D
    if not split:
        return []
    flat = b" ".join(split)
    ends = list(accumulate(len(w) + 1 for w in split))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    if len(split) <= words:
        return [digest(flat, 42)]
    return [digest(flat[s:e - 1], 42) for s, e in zip(starts, ends[words - 1:])]


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint: a bit is set if it is set in over half the shingle hashes; no word: zero."""
    hashes = text_hashes(text, words)
    if not hashes:
        return EMPTY
    h = np.array(hashes, np.uint64)
    n = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        n += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(n * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint_udf(words: int):
    @F.pandas_udf("long")
    def fingerprint(text: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in text], dtype="int64")

    return fingerprint


def embed(fp: Column) -> Column:
    """Segment popcounts in unary code: for two bits a, b the two bits (a or b), (a and b)."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD)), fp.bitwiseAND(F.lit(ODD))
    return F.shiftleft(high.bitwiseOR(low), 1).bitwiseOR(high.bitwiseAND(low))


def _masks(max_bits: int) -> list[int]:
    keep = 8 - max_bits
    masks = [sum(0xFF << (8 * b) for b in c) for c in combinations(range(8), keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(fps, emb, i, others, max_bits):
    """Those of ``others`` within ``max_bits`` of fingerprint i: first by the Manhattan bound, then exactly."""
    some = others[np.bitwise_count(emb[others] ^ emb[i]) <= max_bits]
    return some[np.bitwise_count(fps[some] ^ fps[i]) <= max_bits]


def spanning_links(fps: np.ndarray, emb: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is connected among ``fps``, at most one per fingerprint."""
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            near = _near(fps, emb, i, left, max_bits)
            if len(near):
                a.append(np.full(len(near), i))
                b.append(near)
                stack.extend(near)
                left = np.setdiff1d(left, near, assume_unique=True)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _links_of_cells(max_bits: int):
    def links(cell: np.ndarray, fp: np.ndarray, emb: np.ndarray) -> pd.DataFrame:
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[new, len(cell)])
        out_a, out_b = [], []
        small = np.repeat(size <= SMALL_CELL, size)
        for lag in range(1, SMALL_CELL):
            i = np.flatnonzero(small[:-lag] & (cell[lag:] == cell[:-lag])) if len(cell) > lag else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[np.bitwise_count(emb[i] ^ emb[i + lag]) <= max_bits]
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= max_bits]
            out_a.append(fp[i])
            out_b.append(fp[i + lag])
        for s, n in zip(new[size > SMALL_CELL], size[size > SMALL_CELL]):
            a, b = spanning_links(fp[s:s + n], emb[s:s + n], max_bits)
            out_a.append(fp[s + a])
            out_b.append(fp[s + b])
        a = np.concatenate(out_a) if out_a else np.empty(0, np.uint64)
        b = np.concatenate(out_b) if out_b else np.empty(0, np.uint64)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        return links(pdf["cell"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["emb"].to_numpy().view(np.uint64))

    def run(batches):
        kept: list[pd.DataFrame] = []  # the last cell may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            if kept and pdf["cell"].iat[0] == kept[0]["cell"].iat[0] == pdf["cell"].iat[-1]:
                kept.append(pdf)
                continue
            pdf = pd.concat([*kept, pdf], ignore_index=True)
            cell = pdf["cell"].to_numpy()
            end = int(np.searchsorted(cell, cell[-1], side="left"))
            kept = [pdf.iloc[end:]]
            if end:
                yield of(pdf.iloc[:end])
        if kept:
            yield of(pd.concat(kept, ignore_index=True))

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, cell_block: int = CELL_BLOCK) -> DataFrame:
    """Links ``a, b`` (fp) that connect every pair of distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits."""
    n = parallelism(fps.sparkSession)
    masks = _masks(max_bits)
    # dealt out evenly first: each fingerprint becomes len(masks) rows, so few input files would make few, large tasks
    dealt = (fps.select("fp").repartition(n).select("fp", embed(F.col("fp")).alias("emb"))
             .select("fp", "emb", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("k", "m"))
             .select(F.xxhash64("k", F.col("emb").bitwiseAND(F.col("m"))).alias("cell"), "fp", "emb"))
    # cells over one block are few: at most len(masks) * n / cell_block of them
    crowded = dealt.groupBy("cell").count().where(F.col("count") > cell_block).select(
        "cell", F.ceil(F.col("count") / cell_block).cast("int").alias("blocks"))
    crowded = materialise(crowded, "crowded")
    if crowded.isEmpty():
        cells = dealt
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        split = (dealt.join(crowded, "cell").withColumn("own", own).withColumn("other", other)
                 .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp", "emb"))
        cells = dealt.join(crowded, "cell", "left_anti").unionByName(split)
    return (cells.repartition(n, "cell").sortWithinPartitions("cell")
            .mapInPandas(_links_of_cells(max_bits), "a long, b long").where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(links: DataFrame, max_steps: int = 100) -> DataFrame:
    """``node, label`` of every node of the undirected ``links`` (a > b): the smallest node of its component.

    Alternates large-star and small-star steps; each is written to the shared folder, and a
    step joins the links with one minimum per node, so no neighbour list is ever gathered.
    """
    edges = materialise(links, "links")
    state = None
    for _ in range(max_steps):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        step = (small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m"))
                .where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        edges = materialise(step, "links")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def label_classes(classes: DataFrame, max_bits: int, cell_block: int) -> DataFrame:
    """``classes`` (one row per fingerprint ``fp``) with ``label``, the smallest fingerprint of its component."""
    labels = materialise(components(link_fingerprints(classes, max_bits, cell_block)), "labels")
    return classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(*classes.columns, F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, cell_block: int = CELL_BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (the smallest
    id reachable over links of ``max_bits`` or fewer differing bits), ``n_copies`` (rows with that fingerprint).

    Null and word-less texts have fingerprint zero, linked like any other. Rows with a null id
    take part but name no component (null if all ids of a component are null). Repeated rows
    are returned each; a very long text is hashed whole, its bits counted in steps. An empty table gives no
    rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    marked = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                     fingerprint_udf(words)(F.col(text_col).cast("string")).alias("fp")), "fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")), "classes")
    labelled = label_classes(classes, max_bits, cell_block)
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(smallest, "label").select("fp", "component_id", "n_copies")
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
             cell_block: int = CELL_BLOCK) -> DataFrame:
    """One row of each component of near-duplicates, all columns kept.

    The row with the smallest id stays (rows without an id come last); of several such rows the one with the smallest hash of
    its text, then any one, which a written number fixes for all retries. So every component keeps exactly one row, also where
    ids repeat or are missing; texts without words are one component. An empty table gives no rows; columns of any name pass.
    """
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    row = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("at"),
                   fingerprint_udf(words)(text).alias("fp"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"))
    rows = materialise(docs.select(row.alias("r")).select("r.*"), "rows-to-keep")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h", "at")
    classes = materialise(rows.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    kept = label_classes(classes, max_bits, cell_block).groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    return rows.join(kept, "at", "left_semi").select("doc.*")
