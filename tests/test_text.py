import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.tok13a import tokenize_13a
from twins import tok13a

WS_SAMPLES = ["", " ", "a b", " a\tb\n", "x y", "x　y", "a\u001cb", "a\x0bb", " z ", "q\x85r", "é  ü"]


def _one(spark, col_fn, values, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r.o for r in df.select("i", col_fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_syllables_keep_spaces(spark):
    got = _one(spark, tx.syllables, ["ཁྱེད་རང་ག་འདྲས་ཡོད། ང་བདེ་པོ་ཡིན།", "།།", ""])
    assert got[0] == ["ཁྱེད", "རང", "ག", "འདྲས", "ཡོད", " ང", "བདེ", "པོ", "ཡིན"]
    assert got[1] == [] and got[2] == []


def test_words_lower(spark):
    assert _one(spark, tx.words_lower, ["How are you? I am well."])[0] == ["how", "are", "you?", "i", "am", "well."]


def test_python_split_and_strip(spark):
    assert _one(spark, tx.py_split, WS_SAMPLES) == [s.split() for s in WS_SAMPLES]
    assert _one(spark, tx.py_strip, WS_SAMPLES) == [s.strip() for s in WS_SAMPLES]
    assert _one(spark, tx.collapse_ws, WS_SAMPLES) == [" ".join(s.split()) for s in WS_SAMPLES]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n 　\u001cab.།་é", max_size=12), min_size=1, max_size=8))
def test_split_strip_property(spark, values):
    assert _one(spark, tx.py_split, values) == [s.split() for s in values]
    assert _one(spark, tx.py_strip, values) == [s.strip() for s in values]


def test_normalise_script(spark):
    raw = ["ཁྱེད།ང  གྷ", "áb།c", "  ", ""]
    twin = [" ".join(unicodedata.normalize("NFC", s).replace("།", "། ").split()) for s in raw]
    assert _one(spark, tx.normalise_script, raw) == twin
    df = spark.createDataFrame([("bo", "a།b"), ("en", "a།b")], "lang string, t string")
    got = [r.o for r in df.select(tx.normalise_if(F.col("t"), F.col("lang")).alias("o")).collect()]
    assert got == ["a། b", "a།b"]


def test_latin_only(spark):
    assert _one(spark, tx.latin_only, ["Hi, how?", "$5", "Héllo", "", "a|b", "x\ty"]) == [True, False, False, False, False, True]


def test_contains_script(spark):
    assert _one(spark, tx.contains_script, ["abc", "aཀ", "࿿", ""]) == [False, True, True, False]
    assert _one(spark, lambda c: tx.contains_script(c, 0xC0, 0xFF), ["é", "e"]) == [True, False]


def test_length_ratio_and_buckets(spark):
    df = spark.createDataFrame([("ab", "a"), ("abcd", "ab"), ("", "abc"), ("abcdefgh", "ab")], "o string, t string")
    r = [x.r for x in df.select(tx.length_ratio(F.col("t"), F.col("o")).alias("r")).collect()]
    assert r == [0.5, 0.5, 3.0, 0.25]
    n = spark.createDataFrame([(k,) for k in (0, 5, 6, 15, 16)], "n int")
    b = [x.b for x in n.select(tx.length_bucket(F.col("n")).alias("b")).collect()]
    assert b == [tx.BUCKET_SHORT, tx.BUCKET_SHORT, tx.BUCKET_MEDIUM, tx.BUCKET_MEDIUM, tx.BUCKET_LONG]
    assert _one(spark, tx.word_count, ["a b  c", "", " "]) == [3, 0, 0]


def test_percentage_empty_is_null(spark):
    df = spark.createDataFrame([(1, 4), (0, 0)], "n long, t long")
    assert [r.p for r in df.select(tx.percentage(F.col("n"), F.col("t")).alias("p")).collect()] == [25.0, None]


TOK_SAMPLES = ["Hello, world!", "It costs $5.00 - really?", "a-b 3-4 x.y 1,000 end.", "&amp;lt; <skipped> z-\ny",
               "Tab\there (paren) [b] {c}", "", "   trailing   "]


def test_tok13a_twin(spark):
    assert _one(spark, tokenize_13a, TOK_SAMPLES) == [tok13a(s) for s in TOK_SAMPLES]
    assert _one(spark, lambda c: tokenize_13a(c, rstrip=True), TOK_SAMPLES) == [tok13a(s, True) for s in TOK_SAMPLES]


PIECES = list("ab9 0.,-\\`[]^_{}~|!\"#$%&'()*+:;<=>?@/\n\t") + ["&amp;", "&quot;", "&lt;", "&gt;", "<skipped>", "-\n", "é"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=8))
def test_tok13a_property(spark, values):
    assert _one(spark, tokenize_13a, values) == [tok13a(s) for s in values]
    assert _one(spark, lambda c: tokenize_13a(c, rstrip=True), values) == [tok13a(s, True) for s in values]
