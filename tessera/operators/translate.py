"""Translation jobs (T1-T8) over a pluggable model.

* ``DictionaryModel``: the trainable model on Spark, a lookup view ``(tok, out)``
  fitted from pairs by dictionary induction (T5), used by join (J3/J4).
* ``FunctionModel``: any batch translator ``list[str] -> list[str]``, loaded once
  per Python worker and applied to batches of texts of about equal length, cut at a
  greatest length (the hook for neural models, which are not part of this engine).

The back-translation loop (T6) writes and commits every round's models and synthetic pairs
in the shared folder and reads them back, so each round starts from a short
lineage, survives lost executors and can be taken up again after a stop.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import Script, normalise_if, py_split
from tessera.operators.dictionary import (
    align_tokens, dictionary_entries, dictionary_state, forward_view, induce_dictionary, map_tokens, merge_states, state_view,
    translate as translate_by_join,
)
from tessera.plans.physical import DEFAULT_BROADCAST_ROWS, spread
from tessera.session import shared_folder


@dataclass
class DictionaryModel:
    view: DataFrame  # (tok, out)
    src: Script
    tgt: Script
    broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS

    def apply(self, df: DataFrame, keys: list[str], text_col: str, out_col: str, dealt: bool = False) -> DataFrame:
        return translate_by_join(df, keys, text_col, self.view, self.src, self.tgt.joiner, out_col, self.broadcast_rows, dealt=dealt)


_LOADED: dict[str, Callable] = {}


def cut_words(text: Column, length: Column, most: int | None) -> Column:
    """The first ``most`` words, joined by spaces, of a text of more (``length``) words; other texts as they are."""
    return text if most is None else F.when(length > most, F.array_join(F.slice(py_split(text), 1, most), " ")).otherwise(text)


@dataclass
class FunctionModel:
    """``load()`` returns ``fn(list[str]) -> list[str]``; called once per worker process.

    Texts are cut at ``max_length`` words and results at ``max_new`` words (None: not at all). Rows are sorted by length
    within their partitions first, so the texts of a batch need about the same padding, and a batch holds at most
    ``batch_size`` texts and ``batch_words`` words (one longer text is a batch of its own). Null texts count as empty.
    """

    load: Callable[[], Callable[[list[str]], list[str]]]
    batch_size: int = 16
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    max_length: int | None = None
    max_new: int | None = None
    batch_words: int = 16_384

    def apply(self, df: DataFrame, keys: list[str], text_col: str, out_col: str) -> DataFrame:
        from tessera.session import ship_package

        ship_package(df.sparkSession)
        load, most, words, name = self.load, self.batch_size, self.batch_words, self.name
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = spread(df).withColumn("_len", F.size(py_split(text)))
        rows = rows.withColumn("_cut", cut_words(text, F.col("_len"), self.max_length)).sortWithinPartitions("_len")
        if self.max_length is not None:
            rows = rows.withColumn("_len", F.least("_len", F.lit(self.max_length)))

        @F.pandas_udf("string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            fn = _LOADED.get(name)
            if fn is None:
                fn = _LOADED[name] = load()
            for texts, lengths in batches:
                texts, out = texts.tolist(), []
                for i, j in batch_bounds(lengths.tolist(), most, words):
                    out.extend(fn(texts[i:j]))
                yield pd.Series(out, dtype=object)

        done = rows.withColumn(out_col, run.asNondeterministic()("_cut", "_len"))
        return done.withColumn(out_col, cut_words(F.col(out_col), F.size(py_split(F.col(out_col))), self.max_new)).drop("_len", "_cut")


def batch_bounds(lengths: list[int], most: int, words: int) -> list[tuple[int, int]]:
    """Consecutive ranges of at most ``most`` texts and, where they hold more than one, ``words`` words."""
    out, first, held = [], 0, 0
    for i, n in enumerate(lengths):
        if i > first and (i - first == most or held + n > words):
            out.append((first, i))
            first, held = i, 0
        held += n
    return out + [(first, len(lengths))] if lengths else out


def translate(df: DataFrame, model, keys: list[str], text_col: str, out_col: str = "translation") -> DataFrame:
    """Translate one text column; every input row gives one output row."""
    return model.apply(df, keys, text_col, out_col)


def fit_dictionary_model(pairs: DataFrame, src_col: str, tgt_col: str, src: Script, tgt: Script, order: list[str],
                         broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS) -> DictionaryModel:
    """T5: the dictionary model fitted from pairs (last write wins in ``order``)."""
    d = induce_dictionary(pairs, src_col, tgt_col, src, tgt, order)
    return DictionaryModel(forward_view(dictionary_entries(d)), src, tgt, broadcast_rows)


def save_model(model: DictionaryModel, path: str) -> None:
    model.view.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, src: Script, tgt: Script, fallback: DictionaryModel | None = None,
               broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS) -> DictionaryModel:
    """T4: load a saved model; a missing path gives ``fallback`` (or an empty model)."""
    from pyspark.errors import AnalysisException
    from tessera.sources.text_files import is_missing

    try:
        view = spark.read.parquet(path)
        return DictionaryModel(view, src, tgt, broadcast_rows)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        if fallback is not None:
            return fallback
        return DictionaryModel(spark.createDataFrame([], "tok string, out string"), src, tgt, broadcast_rows)


def synthetic_pairs(mono: DataFrame, model, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(keys..., orig, trans)`` from monolingual text."""
    t = translate(mono.select(*keys, F.col(text_col).alias("orig")), model, keys, "orig", "trans")
    return t.select(*keys, "orig", "trans")


def generate_translation(df: DataFrame, model, keys: list[str], text_col: str, lang_col: str,
                         source_lang: str = "bo", end_mark: str = "།") -> DataFrame:
    """Script normalisation when the source language is ``source_lang`` (P6), then T1."""
    pre = df.withColumn("_pre", normalise_if(F.col(text_col), F.col(lang_col), source_lang, end_mark))
    return translate(pre, model, keys, "_pre", "translation").drop("_pre")


def round_trip(mono: DataFrame, there, back, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(keys..., orig, trans, back)``. With small dictionaries both lookups happen where the row is, without a shuffle."""
    s = synthetic_pairs(mono, there, keys, text_col)
    if isinstance(there, DictionaryModel) and isinstance(back, DictionaryModel):
        return back.apply(s, keys, "trans", "back", dealt=True).select(*keys, "orig", "trans", "back")
    return translate(s, back, keys, "trans", "back").select(*keys, "orig", "trans", "back")


def evaluate(test: DataFrame, model, keys: list[str], src_col: str = "source", ref_col: str = "reference") -> DataFrame:
    """Translate a test set and score it (corpus BLEU, exp-smoothed, 0-100)."""
    from tessera.functions.tok13a import tokenize_13a
    from tessera.operators.metrics.ngrams import BLEU_STAT_COLS, sum_stats, with_bleu_stats
    from tessera.operators.metrics.scores import bleu_exp, r6

    t = translate(test, model, keys, src_col, "prediction")
    st = sum_stats(with_bleu_stats(t, keys, tokenize_13a(F.col("prediction"), True), tokenize_13a(F.col(ref_col), True)),
                   BLEU_STAT_COLS)
    return st.select(r6(bleu_exp()).alias("bleu"), F.col("n_rows").alias("count"))


def written_once(spark: SparkSession, out_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` under ``out_dir``: read if an earlier run has committed it, else made, written and committed.

    The commit marker is a table of one row, written after the data; data without its marker (a run that
    was stopped) is written again.
    """
    from pyspark.errors import AnalysisException
    from tessera.sources.text_files import is_missing

    path, marker = f"{out_dir}/{name}", f"{out_dir}/commits/{name}"
    try:
        done = spark.read.schema("name string").json(marker).count() == 1
    except AnalysisException as e:
        if not is_missing(e):
            raise
        done = False
    if not done:
        make().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").json(marker)
    return spark.read.parquet(path)


def back_translation(spark: SparkSession, parallel: DataFrame, mono_a: DataFrame, mono_b: DataFrame,
                     a: Script, b: Script, rounds: int = 3, quality_threshold: float | None = None,
                     out_dir: str | None = None) -> DataFrame:
    """Iterative back-translation with dictionary models.

    ``parallel``: ``(o1, o2, a_text, b_text)`` with an order key (o1, o2);
    ``mono_a`` / ``mono_b``: ``(id, text)``. Round i:

    1. S_a = translate(mono_a, a->b);
    2. model b->a fitted on swap(P) followed by swap(S_a);
    3. S_b = translate(mono_b, new b->a);
    4. model a->b fitted on P followed by swap(S_b) (the synthetic side swapped).

    P is never extended with earlier rounds' pairs. It is aligned once per direction, into a stored dictionary state (last
    write and first key per token); a refit merges that state with the state of the round's synthetic pairs,
    so a round reads only its synthetic side. In a refit the synthetic text is the
    source; its tokens carry a flag from the lookup that says which were unknown, and these
    are not learnt as sources. ``quality_threshold`` turns on F5 for the synthetic pairs (off
    by default). Returns all synthetic pairs with ``iteration`` and ``direction``.

    Everything is written under ``out_dir`` and committed step by step: a run that is started again with the same
    ``out_dir`` and inputs goes on after the last committed step.
    """
    out_dir = out_dir or f"{shared_folder(spark).rstrip('/')}/back-translation-{uuid.uuid4().hex}"
    order = ["origin", "o1", "o2"]

    def real_state(src_col, tgt_col, src, tgt, direction):
        real = parallel.select(F.lit(0).alias("origin"), F.col("o1").cast("long"), F.col("o2").cast("long"), src_col, tgt_col)
        return written_once(spark, out_dir, f"states/{direction}", lambda: dictionary_state(
            align_tokens(real, src.tokens(F.col(src_col)), tgt.tokens(F.col(tgt_col)), order), order))

    def refit(state, synthetic, src, tgt, direction, i):
        made = synthetic.select(F.lit(1).alias("origin"), F.col("id").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"),
                                "tokens", "missing", tgt.tokens(F.col("orig")).alias("other"))
        known = F.transform("tokens", lambda t, i: F.when(~F.get(F.col("missing"), i), t))  # unknown tokens align with nothing
        learnt = dictionary_state(align_tokens(made.withColumn("known", known), F.col("known"), F.col("other"), order), order)
        return DictionaryModel(written_once(spark, out_dir, f"models/{direction}/iteration_{i}",
                                            lambda: state_view(merge_states(state, learnt))), src, tgt)

    def generate(mono, model, back_model, i, direction):
        def pairs():
            given = mono.select("id", F.col("text").alias("orig"))
            s = map_tokens(given, model.src.tokens(F.col("orig")), model.view, "tokens", broadcast_rows=model.broadcast_rows,
                           missing_name="missing").withColumn("trans", F.array_join("tokens", model.tgt.joiner))
            if quality_threshold is not None:
                good = _filtered(s.select("id", "orig", "trans"), back_model, quality_threshold).select("id")
                s = s.join(good, "id", "left_semi")
            return s.select("id", "orig", "trans", "tokens", "missing")

        return written_once(spark, out_dir, f"synthetic/iteration={i}/direction={direction}", pairs)  # cuts the lineage

    states = {"a-b": real_state("a_text", "b_text", a, b, "a-b"), "b-a": real_state("b_text", "a_text", b, a, "b-a")}
    ab, ba = (DictionaryModel(written_once(spark, out_dir, f"models/{d}/baseline", lambda s=s: state_view(s)), src, tgt)
              for (d, s), (src, tgt) in zip(states.items(), ((a, b), (b, a))))
    for i in range(1, rounds + 1):
        s_a = generate(mono_a, ab, ba, i, "a-b")
        ba = refit(states["b-a"], s_a, b, a, "b-a", i)
        s_b = generate(mono_b, ba, ab, i, "b-a")
        ab = refit(states["a-b"], s_b, a, b, "a-b", i)
    return spark.read.parquet(f"{out_dir}/synthetic").select("id", "orig", "trans", "iteration", "direction")


def _filtered(pairs: DataFrame, back_model, threshold: float) -> DataFrame:
    from tessera.operators.filters import quality_filter

    rt = translate(pairs, back_model, ["id"], "trans", "back")
    return quality_filter(rt, ["id"], threshold=threshold)
