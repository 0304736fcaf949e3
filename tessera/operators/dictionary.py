"""Dictionary induction and translation.

A dictionary is a table, never a driver-side map, so it can outgrow one machine:

* entries ``(seq, src, tgt)``: raw entries in load order (``seq`` may be a struct);
* a lookup view ``(tok, out)``: one row per key, last write wins.

Tokens are replaced in one of two ways, chosen by the checked size of the view:

* a view of at most ``LOCAL_ROWS`` rows and ``LOCAL_BYTES`` bytes is sent to the tasks, and each Arrow batch
  of token lists is looked up as a whole. Every row stays where it is: no shuffle, no row keys,
  nothing that equal rows, null keys or one very long row could upset;
* otherwise rows are written once, in blocks of about ``BLOCK`` tokens that lie together. The distinct tokens of a
  block, not their occurrences, are joined with the view (by shuffle, where AQE splits hot tokens); the values go to
  where the block's rows are dealt, which stream past them: a task holds one block's values at a time. A row of more than ``BLOCK``
  tokens is cut into segments, each a block of its own, which are put together by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import Script, missing_marker
from tessera.plans.physical import DEFAULT_BROADCAST_ROWS, ID_BITS, bounded_broadcast, cut_lineage, spread

# Limits below which a lookup view is held by every Python worker.
LOCAL_ROWS = 2_000_000
LOCAL_BYTES = 64 << 20
# Limits below which the join broadcasts it.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
# Tokens in a block of rows.
BLOCK = 1 << 20


def align_tokens(pairs: DataFrame, src_tokens: Column, tgt_tokens: Column, order: list[str]) -> DataFrame:
    """The i-th source token with the i-th target token, up to the shorter list.

    Returns ``(*order, pos, src, tgt)``.
    """
    z = pairs.select(*order, src_tokens.alias("_s"), tgt_tokens.alias("_t"))
    z = z.select(*order, F.posexplode(F.arrays_zip("_s", "_t")).alias("pos", "_z")).withColumn("pos", F.col("pos").cast("long"))
    return z.where(F.col("_z._s").isNotNull() & F.col("_z._t").isNotNull()).select(
        *order, "pos", F.col("_z._s").alias("src"), F.col("_z._t").alias("tgt")
    )


def induce_dictionary(pairs: DataFrame, src_col: str, tgt_col: str, src_script: Script, tgt_script: Script,
                      order: list[str]) -> DataFrame:
    """A1: positional alignments over all pairs; last write wins per source token in
    ``(order, pos)`` order; ``first_*`` gives the first time the token was seen.

    Both aggregates combine map-side, so a frequent token ships one row per task.
    """
    al = align_tokens(pairs, src_script.tokens(F.col(src_col)), tgt_script.tokens(F.col(tgt_col)), order)
    return last_writes(al, order)


def last_writes(al: DataFrame, order: list[str]) -> DataFrame:
    """A1 over aligned tokens ``(*order, pos, src, tgt)``."""
    d = dictionary_state(al, order)
    return d.select("src", "tgt", *[F.col(f"first.{c}").alias(f"first_{c}") for c in [*order, "pos"]])


def dictionary_state(al: DataFrame, order: list[str]) -> DataFrame:
    """What of the aligned tokens ``(*order, pos, src, tgt)`` is needed to go on later: ``src, tgt, last, first``,
    the value written last with its key ``(*order, pos)`` and the first key. One row per source token."""
    key = F.struct(*[F.col(c) for c in order], F.col("pos"))
    return merge_states(al.select("src", "tgt", key.alias("last"), key.alias("first")))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state from several (in any order): last write wins by key, the first key is the least."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("src").agg(F.max_by("tgt", "last").alias("tgt"), F.max("last").alias("last"), F.min("first").alias("first"))


def state_view(state: DataFrame) -> DataFrame:
    """The lookup view ``(tok, out)`` of a state."""
    return state.select(F.col("src").alias("tok"), F.col("tgt").alias("out"))


def dictionary_entries(dictionary: DataFrame) -> DataFrame:
    """Entries of an induced dictionary in its file (first-seen) order, as ``(seq, src, tgt)``."""
    firsts = [c for c in dictionary.columns if c.startswith("first_")]
    return dictionary.select(F.struct(*firsts).alias("seq"), "src", "tgt")


def forward_view(entries: DataFrame) -> DataFrame:
    """A2 forward: last write wins per source key."""
    return entries.groupBy(F.col("src").alias("tok")).agg(F.max_by("tgt", "seq").alias("out"))


def reverse_view(entries: DataFrame) -> DataFrame:
    """A2 reverse: last write wins per target key over all raw entries (not an inversion
    of the forward view: stale reverse entries survive when sources repeat)."""
    return entries.groupBy(F.col("tgt").alias("tok")).agg(F.max_by("src", "seq").alias("out"))


ROW = "_row"


def usable_entries(view: DataFrame) -> DataFrame:
    """The entries of a view that hold a value (F6: an empty one counts as missing)."""
    keep = F.col("out").isNotNull() & F.col("tok").isNotNull()
    if dict(view.dtypes)["out"] == "string":
        keep = keep & (F.col("out") != "")
    return view.where(keep).select("tok", "out")


def local_view(view: DataFrame, max_rows: int, max_bytes: int = LOCAL_BYTES) -> pa.Table | None:
    """The (written) view as one Arrow table if it has at most ``max_rows`` rows and ``max_bytes`` bytes of strings, else None."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in view.dtypes if t == "string"]
    size = view.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(strings, F.lit(0))), F.lit(0)).alias("b")).first()
    return view.toArrow() if size.n <= max_rows and size.b <= max_bytes else None


@dataclass(frozen=True)
class Missing:
    """What stands for a token without a value, as a column function and for an Arrow array of tokens."""

    column: Callable[[Column], Column]
    arrow: Callable[[pa.Array], pa.Array | pa.Scalar]


#: The token in brackets.
MARKED = Missing(missing_marker, lambda tokens: pc.binary_join_element_wise("[", tokens, "]", ""))


def found_in(tokens: Column, table: pa.Table, kind: T.DataType, missing: Missing, joiner: str | None = None, flags: bool = False) -> Column:
    """The values of the tokens in ``table`` (``tok, out``): an array, or with ``joiner`` one string; with
    ``flags`` a struct of the array ``v`` and an array ``m`` that says which were missing."""
    values = T.ArrayType(kind)
    out = T.StringType() if joiner is not None else T.StructType().add("v", values).add("m", T.ArrayType(T.BooleanType())) if flags else values

    @F.arrow_udf(out)
    def find(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        keys, known = table.column("tok").combine_chunks(), table.column("out").combine_chunks()
        ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())])
        found = known.take(pc.index_in(flat, value_set=keys.cast(flat.type)))
        listed = pa.ListArray.from_arrays(ends, pc.coalesce(found, missing.arrow(flat)))
        if joiner is not None:
            return pc.binary_join(listed, joiner)
        if flags:
            return pa.StructArray.from_arrays([listed, pa.ListArray.from_arrays(ends, found.is_null())], names=["v", "m"])
        return listed

    # so that a filter on the result is neither moved before the rows are dealt out nor makes it be computed twice
    return find.asNondeterministic()(tokens)


def block_numbers(n_tokens: Column, size: int) -> Column:
    """A number for every row: rows that follow each other in a task share it until they hold ``size`` tokens."""
    @F.pandas_udf("long")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        before = 0
        for lengths in batches:
            ends = lengths.fillna(0).clip(lower=0).cumsum() + before
            before = int(ends.iloc[-1]) if len(ends) else before
            yield (TaskContext.get().partitionId() << ID_BITS) + (ends // size).astype("int64")

    return number.asNondeterministic()(n_tokens)


def values_of(kind: T.DataType, joiner: str | None) -> Callable[..., Column]:
    """A function of the columns (block, tokens, token, its value, whether that was missing) over rows sorted by block, the
    dictionary rows of a block (null ``tokens``) first: a struct of the values ``v`` (with ``joiner`` one string) and the
    flags ``m``, null for dictionary rows."""
    value = T.ArrayType(kind) if joiner is None else T.StringType()
    types = [pa.string() if joiner is not None else pa.list_(to_arrow_type(kind)), pa.list_(pa.bool_())]

    @F.arrow_udf(T.StructType().add("v", value).add("m", T.ArrayType(T.BooleanType())))
    def look_up(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held, entries, table = None, [], None
        for block, lists, tok, out, gone in batches:
            ends = [*np.flatnonzero(np.diff(block.to_numpy(zero_copy_only=False))) + 1, len(block)]
            done, start = [], 0
            for end in ends:
                n, rows = end - start, lists.slice(start, end - start)
                if n and block[start].as_py() != held:
                    held, entries, table = block[start].as_py(), [], None
                first = rows.null_count  # dictionary rows come first
                if first:
                    entries.append([c.slice(start, first) for c in (tok, out, gone)])
                texts = rows.slice(first)
                if len(texts) and table is None:
                    table = [pa.concat_arrays(c) for c in zip(*entries)] or [c.slice(0, 0) for c in (tok, out, gone)]
                    entries = []
                parts = []
                if len(texts):
                    flat = texts.flatten()
                    at = pc.index_in(flat, value_set=table[0].cast(flat.type))
                    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.list_value_length(texts)).cast(pa.int32())])
                    v, m = (pa.ListArray.from_arrays(offsets, c.take(at)) for c in table[1:])
                    parts = [v if joiner is None else pc.binary_join(v, joiner), m]
                done.append((first, parts))
                start = end
            columns = [pa.chunked_array([x for first, parts in done for x in (pa.nulls(first, t), *([parts[k].cast(t)] if parts else []))], t).combine_chunks()
                       for k, t in enumerate(types)]
            yield pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns], names=["v", "m"], mask=lists.is_null())

    return look_up.asNondeterministic()


def segments(tokens: Column, size: int = BLOCK) -> Column:
    """The token list cut into lists of ``size`` (one empty list for an empty or null one)."""
    last = F.floor((F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.coalesce(tokens, F.array().cast("array<string>")), i * size + 1, size))


def looked_up(rows: DataFrame, tokens: Column, view: DataFrame, default, partitions: int, joiner: str | None) -> DataFrame:
    """The rows of a written table with a ``_block`` plus ``_found``: the values ``v`` of their tokens and which were missing ``m``."""
    words = rows.select("_block", F.explode(tokens).alias("_tok")).distinct()
    met = words.join(view.select(F.col("tok").alias("_tok"), F.col("out").alias("_out")), "_tok", "left").select(
        "_block", F.lit(0).alias("_text"), "_tok", F.coalesce("_out", default(F.col("_tok"))).alias("_out"), F.col("_out").isNull().alias("_gone"))
    dealt = rows.withColumn("_text", F.lit(1)).unionByName(met, allowMissingColumns=True).repartition(partitions, "_block").sortWithinPartitions("_block", "_text")
    found = values_of(view.schema["out"].dataType, joiner)("_block", F.when(F.col("_text") == 1, tokens), "_tok", "_out", "_gone")
    return dealt.withColumn("_found", found).where(F.col("_found").isNotNull()).select(*rows.columns, "_found")


def joined_tokens(df: DataFrame, tokens: Column, view: DataFrame, out_name: str, default, broadcast_rows: int | None,
                  missing_name: str | None, segment: int = BLOCK, joiner: str | None = None) -> DataFrame:
    """``map_tokens`` by joins (see the top of this module), in blocks of about ``segment`` tokens."""
    listed = F.coalesce(tokens, F.array().cast("array<string>"))
    counted = df.withColumn("_n", F.size(listed))
    rows = cut_lineage(counted.withColumn("_block", block_numbers(F.col("_n"), segment)).withColumn(ROW, F.monotonically_increasing_id()), "rows")
    if broadcast_rows is not None:
        view, _ = bounded_broadcast(view, min(broadcast_rows, BROADCAST_ROWS), BROADCAST_BYTES)
    size = rows.agg(F.count_distinct("_block").alias("blocks"), F.max("_n").alias("longest"), F.sum(F.when(F.col("_n") > segment, F.col("_n"))).alias("long")).first()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def given(found: DataFrame, v: Column, m: Column) -> DataFrame:
        return found.select(*df.columns, v.alias(out_name), *([m.alias(missing_name)] if missing_name else []))

    short = looked_up(rows.where(F.col("_n") <= segment), listed, view, default, max(n, size.blocks), joiner)
    short = given(short, F.col("_found.v"), F.col("_found.m"))
    if (size.longest or 0) <= segment:
        return short
    long = rows.where(F.col("_n") > segment)
    parts = long.select(F.col(ROW).alias("_id"), F.posexplode(segments(listed, segment)).alias("_seg", "_part")).withColumn("_block", F.xxhash64("_id", "_seg"))
    parts = looked_up(cut_lineage(parts.repartition(n, "_block"), "segments"), F.col("_part"), view, default, max(n, size.long // segment), None)
    whole = parts.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_seg", F.col("_found.v").alias("v"), F.col("_found.m").alias("m")))).alias("_parts"))
    v = F.flatten(F.col("_parts.v"))
    return short.unionByName(given(long.join(whole, F.col(ROW) == F.col("_id")), v if joiner is None else F.array_join(v, joiner), F.flatten(F.col("_parts.m"))))


def map_tokens(df: DataFrame, tokens: Column, view: DataFrame, out_name: str, missing: Missing = MARKED,
               broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS, missing_name: str | None = None, local_rows: int = LOCAL_ROWS,
               joiner: str | None = None, dealt: bool = False) -> DataFrame:
    """``df`` plus the column ``out_name``: the tokens of each row replaced by their values in ``view`` (``tok, out``), as an
    array, or joined to a string.

    One output row per input row. A missing or empty value (F6) gives ``missing``; ``missing_name`` adds an array
    that says which. Rows with no token, or null tokens, get an empty array or string. ``dealt`` says that the rows are spread
    over all cores already.
    """
    from tessera.session import ship_package

    ship_package(df.sparkSession)
    kind = view.schema["out"].dataType
    view = cut_lineage(usable_entries(view), "lookup")  # measured, then held or joined
    table = local_view(view, local_rows if broadcast_rows is None else min(local_rows, broadcast_rows))
    if table is None:
        return joined_tokens(df if dealt else spread(df), tokens, view, out_name, missing.column, broadcast_rows, missing_name, joiner=joiner)
    found = found_in(F.coalesce(tokens, F.array().cast("array<string>")), table, kind, missing, joiner, missing_name is not None)
    df = df if dealt else spread(df)
    if missing_name is None:
        return df.withColumn(out_name, found)
    return df.withColumn("_found", found).select(*df.columns, F.col("_found.v").alias(out_name), F.col("_found.m").alias(missing_name))


def translate(df: DataFrame, keys: list[str], text_col: str, view: DataFrame, src_script: Script,
              joiner: str, out_col: str = "translation", broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS,
              local_rows: int = LOCAL_ROWS, dealt: bool = False) -> DataFrame:
    """J3 (forward view, joiner ``' '``) / J4 (reverse view, joiner ``''``). One output row per input row, also where ``keys`` repeat or are null."""
    return map_tokens(df, src_script.tokens(F.col(text_col)), view, out_col, broadcast_rows=broadcast_rows, local_rows=local_rows, joiner=joiner, dealt=dealt)


def both_ways(pairs: DataFrame, entries: DataFrame, key: str | list[str] = "line_no", src_col: str = "bo", tgt_col: str = "en",
              src_script: Script | None = None, tgt_script: Script | None = None,
              broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS, dealt: bool = False) -> DataFrame:
    """Original, actual, translated to target (forward) and back to source (reverse); one output row per pair."""
    from tessera.functions.text import ENGLISH, TIBETAN

    src_script = src_script or TIBETAN
    tgt_script = tgt_script or ENGLISH
    keys = [key] if isinstance(key, str) else key
    given = pairs.select(*keys, F.col(src_col).alias("original_src"), F.col(tgt_col).alias("actual_tgt"))
    out = translate(given, keys, "original_src", forward_view(entries), src_script, tgt_script.joiner, "translated_tgt", broadcast_rows, dealt=dealt)
    return translate(out, keys, "actual_tgt", reverse_view(entries), tgt_script, src_script.joiner, "translated_src", broadcast_rows, dealt=True)
