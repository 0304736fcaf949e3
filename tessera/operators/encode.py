"""Fixed-length and longest-in-batch encodings.

The subword models of the reference are replaced by a vocabulary table
``(tok, id)``: ids are dense in token order after the special ids. Token ids
come from the same position-preserving lookup as translation (a join, never a
driver-side map).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.dictionary import Missing, map_tokens
from tessera.plans.physical import DEFAULT_BROADCAST_ROWS, cut_lineage, dense_row_number

# Fixed values of this engine: special ids.
PAD_ID = 0
UNK_ID = 1
N_SPECIAL = 2


def build_vocabulary(*token_arrays: DataFrame) -> DataFrame:
    """``(tok, id)`` over the distinct tokens of one-column array frames; ids follow token order."""
    toks = None
    for df in token_arrays:
        t = df.select(F.explode(df.columns[0]).alias("tok"))
        toks = t if toks is None else toks.unionByName(t)
    distinct = cut_lineage(toks.distinct(), "vocabulary")  # numbering reads it several times
    return dense_row_number(distinct, ["tok"], "_r").select("tok", (F.col("_r") + N_SPECIAL).alias("id"))


def _as_view(vocab: DataFrame) -> DataFrame:
    return vocab.select("tok", F.col("id").alias("out"))


UNKNOWN = Missing(lambda tok: F.lit(UNK_ID).cast("long"), lambda tokens: pa.scalar(UNK_ID, pa.int64()))


def _ids(df: DataFrame, tokens: Column, vocab: DataFrame, name: str, broadcast_rows, dealt: bool = False) -> DataFrame:
    return map_tokens(df, tokens, _as_view(vocab), name, UNKNOWN, broadcast_rows=broadcast_rows, dealt=dealt)


def pad_to(ids: Column, length: Column) -> Column:
    """Cut to ``length`` and pad with PAD_ID up to it."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(PAD_ID).cast("long"), length - F.size(cut)))


def mask_to(ids: Column, length: Column) -> Column:
    n = F.least(F.size(ids), length)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))


def encode_fixed(pairs: DataFrame, keys: list[str], src_tokens: Column, tgt_tokens: Column, vocab: DataFrame,
                 max_length: int = 128, broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``input_ids``, ``attention_mask``, ``labels`` cut and padded to ``max_length``."""
    both = pairs.select(*keys, src_tokens.alias("_st"), tgt_tokens.alias("_tt"))
    both = _ids(_ids(both, F.col("_st"), vocab, "_sid", broadcast_rows), F.col("_tt"), vocab, "_tid", broadcast_rows, dealt=True)
    L = F.lit(max_length)
    return both.select(
        *keys,
        pad_to(F.col("_sid"), L).alias("input_ids"),
        mask_to(F.col("_sid"), L).alias("attention_mask"),
        pad_to(F.col("_tid"), L).alias("labels"),
    )


def encode_longest(batched: DataFrame, keys: list[str], tokens: Column, vocab: DataFrame, batch_col: str = "batch_id",
                   max_length: int = 512, broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Pad to the longest (cut) sequence of each batch. Batches are bounded in size,
    so the per-batch window is small."""
    base = batched.select(*keys, batch_col, tokens.alias("_st"))
    a = _ids(base, F.col("_st"), vocab, "_sid", broadcast_rows)
    n = F.least(F.size("_sid"), F.lit(max_length))
    longest = F.max(n).over(Window.partitionBy(batch_col))
    return a.withColumn("_len", longest).select(
        *keys, batch_col,
        pad_to(F.col("_sid"), F.col("_len")).alias("input_ids"),
        mask_to(F.col("_sid"), F.col("_len")).alias("attention_mask"),
    )
