"""Property checks: swap twice is the identity; translation keeps every row;
0 <= BLEU <= 1; splits are exact, disjoint and complete for any size and ratio."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import ENGLISH, TIBETAN
from tessera.functions.tok13a import tokenize_13a
from tessera.operators.dictionary import forward_view, translate
from tessera.operators.metrics.ngrams import BLEU_STAT_COLS, sum_stats, with_bleu_stats
from tessera.operators.metrics.scores import bleu_exp, bleu_unsmoothed
from tessera.operators.split import exact_split, train_first_size

WORD = st.sampled_from(["a", "b", "c", "the", "cat", ".", ","])
TEXT = st.lists(WORD, max_size=8).map(" ".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=12))
def test_swap_twice_and_bleu_bounds(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, src string, tgt string")
    swapped = df.select("id", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    back = swapped.select("id", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    assert sorted(back.collect()) == sorted(df.collect())
    st_ = sum_stats(with_bleu_stats(df, ["id"], tokenize_13a(F.col("src")), tokenize_13a(F.col("tgt"))), BLEU_STAT_COLS)
    r = st_.select(bleu_unsmoothed().alias("u"), bleu_exp().alias("s")).first()
    assert 0.0 <= r.u <= 1.0 + 1e-12 and 0.0 <= r.s <= 100.0 + 1e-9


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ཀཁག་། ", max_size=10), min_size=1, max_size=10))
def test_translation_keeps_every_row(spark, texts):
    entries = spark.createDataFrame([(0, "ཀ", "ka"), (1, "ཁ", "")], "seq long, src string, tgt string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = translate(df, ["id"], "text", forward_view(entries), TIBETAN, ENGLISH.joiner)
    assert out.count() == len(texts)


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=1, max_value=300), st.floats(min_value=0.0, max_value=1.0), st.integers(0, 1000))
def test_split_exact_disjoint_complete(spark, n, ratio, seed):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = exact_split(df, "k", seed, train_first_size(ratio)).collect()
    assert sorted(r.k for r in got) == list(range(n))
    assert sum(r.split == "train" for r in got) == int(n * ratio)
