import pytest
from pyspark.sql import functions as F

from tessera.functions.text import ENGLISH, TIBETAN
from tessera.operators.dictionary import forward_view
from tessera.operators.report import corpus_scores
from tessera.streaming.scoring import SCORED_SCHEMA, scored_stream, start_scores, translate_stream

ROWS = [(0, "s", "the cat sat on the mat", "the cat sat on a mat"),
        (1, "s", "a dog ran fast", "the dog ran"),
        (2, "s", "red big car", "big red car"),
        (3, "s", "", "nothing")]


def test_running_scores_equal_batch(spark, tmpdir_path):
    src = f"{tmpdir_path}/in"
    df = spark.createDataFrame(ROWS, SCORED_SCHEMA)
    df.where("id < 2").write.parquet(f"{src}/part1")
    q = start_scores(spark, scored_stream(spark, f"{src}/*"), "scores_a", checkpoint=f"{tmpdir_path}/ck")
    try:
        q.processAllAvailable()
        df.where("id >= 2").write.parquet(f"{src}/part2")
        q.processAllAvailable()
        got = spark.sql("SELECT * FROM scores_a").first()
    finally:
        q.stop()
    want = corpus_scores(df).first()
    assert got.n_rows == 4
    assert (got.bleu, got.bleu_smoothed, got.chrf) == pytest.approx((want.bleu, want.bleu_smoothed, want.chrf))


def test_translate_stream(spark, tmpdir_path):
    entries = spark.createDataFrame([(0, "ཀ", "one"), (1, "ཁ", "two")], "seq long, src string, tgt string")
    src = f"{tmpdir_path}/texts"
    spark.createDataFrame([(0, "ཀ་ཁ།"), (1, "ཁ་ག")], "id long, text string").write.parquet(f"{src}/a")
    stream = spark.readStream.schema("id long, text string").parquet(f"{src}/*")
    q = translate_stream(spark, stream, ["id"], "text", forward_view(entries), TIBETAN, ENGLISH.joiner,
                         f"{tmpdir_path}/out", checkpoint=f"{tmpdir_path}/ck2")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = {r.id: r.translation for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    assert out == {0: "one two", 1: "two [ག]"}
