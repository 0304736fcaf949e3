"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: every operator has a defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, bpe_dropout, chat, decontamination, language_id, licenses, lm_scoring, quality, sharding, simhash
from tessera.llm.common import remainder

LONG = "the quick brown fox jumps over the lazy dog again and again " * 4000
CLASH = {"fp": "1", "label": "x", "size": "9", "score": "2", "shard": "5", "list": "7", "ids": "8", "_part": "3", "text_crc32": "4"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["the cat sat on the mat and the dog ran", "der hund und die katze sind im haus", "", None, "   \n\t ", "!!! ### 123", LONG,
         "the cat sat on the mat and the dog ran", "x", "日本語 テキスト 😀", "le chat et le chien sont dans la maison"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if t and "und" in t else "fr" if t and "le " in t else "en", "s", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all, but a text", None, None, None), (0, TEXTS[0], "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (None, "tiny")],
                                 "item_id long, text string")


def learn():
    return remainder(F.col("doc_id"), 5) != 1


OPERATORS = {
    "leaks": lambda d, b: decontamination.find_leaks(d, b),
    "no_leaks": lambda d, b: decontamination.without_leaks(d, b),
    "scores": lambda d, b: lm_scoring.score_documents(d, learn(), learn() & (F.col("doc_id") == 6), bits=17),
    "encode": lambda d, b: bpe_dropout.encode_documents(d),
    "language": lambda d, b: language_id.identify(d, learn()),
    "identified": lambda d, b: language_id.keep_identified(d, learn()),
    "near": lambda d, b: simhash.near_duplicates(d),
    "one": lambda d, b: simhash.keep_one(d),
    "shards": lambda d, b: sharding.assign_shards(d),
    "quality": lambda d, b: quality.classify(d),
    "good": lambda d, b: quality.keep_good(d),
    "licenses": lambda d, b: licenses.scan_licenses(d),
}
ROW_FOR_ROW = {"scores", "encode", "language", "near", "shards", "quality", "licenses"}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(docs, benchmark, name):
    out = OPERATORS[name](docs, benchmark)
    n = out.count()
    if name in ROW_FOR_ROW:
        assert n == docs.count()
    if name in ("no_leaks", "identified", "one", "good"):
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, benchmark, name):
    assert OPERATORS[name](empty, benchmark).count() == 0


def test_empty_benchmark(docs, benchmark):
    none = benchmark.where("false")
    assert decontamination.find_leaks(docs, none).count() == 0
    assert decontamination.without_leaks(docs, none).count() == docs.count()


def test_values_of_hard_rows(docs, benchmark):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, learn()).collect()}
    assert (3, "und") in got and (2, "und") in got and (5, "und") in got
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] == rows[4]["fingerprint"] == "0" * 16
    assert rows[2]["component_id"] == 2 and rows[4]["component_id"] == 2 and rows[7]["component_id"] == 0
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert kept.count(0) == 1 and 7 not in kept and 3 not in kept
    encoded = {r["doc_id"]: r for r in bpe_dropout.encode_documents(docs).collect() if r["doc_id"] is not None}
    assert encoded[3]["ids"] is None and encoded[2]["ids"] == [] and all(r["lossless"] for i, r in encoded.items() if i != 3)
    assert {r["doc_id"] for r in decontamination.find_leaks(docs, benchmark).collect()} == {6}


def test_pipeline_stages_keep_columns(spark, docs, empty, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, empty):
        d = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == start.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == d.count()


def test_chat_hard_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, 0, "user", "lost"), (2, None, "user", "<|im_end|>"),
            (2, 5, "assistant", ""), (3, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x")).withColumn("n", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 2}
    assert got[1]["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    assert "< |im_end|>" in got[2]["chat"] and got[2]["n_turns"] == 2
    assert chat.format_chats(df.where("false")).count() == 0


def test_vectors_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (2, [0.0, 1.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("ids", F.lit(2))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest_neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 10, 1.0), (0, 3, 2, 0.0), (0, 4, 2, 0.0)]
    # rows that share the query's id are candidates, too: another vector, and a copy of the query's own row
    more = df.select("vec_id", "embedding").unionByName(spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 3.0])], "vec_id long, embedding array<double>"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest_neighbours(more).collect())
    assert got == sorted([(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 10, 1.0), (0, 4, 0, 0.0), (0, 5, 2, 0.0),
                          (0, 1, 2, 1.0), (0, 2, 2, 1.0), (0, 3, 0, 0.0), (0, 4, 0, 0.0), (0, 5, 1, 0.0)])
    assert ann.nearest_neighbours(df.where("false")).count() == 0
