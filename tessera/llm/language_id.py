"""Operator 4: language identification by compression.

Each language has a raw-content zstandard dictionary: whole learning texts of that language,
chosen by the order of a hash of their id, up to ``dictionary_bytes``. A text is compressed
once with every dictionary and belongs to the language that makes it smallest. The score is
the relative margin to the second smallest, 1 - best / second; predictions with a score
under ``min_margin`` are rejected (their ``lang_pred`` still names the best language). A tie is rejected at any
length. Sizes are whole bytes, so in a text of under 1 / ``min_margin`` compressed bytes one byte of
difference is enough, and in longer ones the difference must grow with the length.

Texts and dictionaries are folded first: lower case, and every run of other signs than
letters as one space. A text is compressed in chunks of ``CHUNK`` bytes, each against the
dictionary alone, so that a long text cannot outweigh the dictionary by its own repeats.

The sample that fits the dictionaries is bounded by ``dictionary_bytes`` for each language;
everything else covers all rows and whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import prepare

DICTIONARY_BYTES = 64 << 10
MIN_MARGIN = 0.004
CHUNK = 2048
LEVEL = 6
UND = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).encode()


def fit_dictionaries(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """One dictionary per language of the rows where ``learn`` holds (null languages and empty texts left out).

    Rows are drawn by a hash of id and text; the share drawn of a language follows its total
    size, so about twice ``dictionary_bytes`` per language reach the driver, however large
    the table is. A text over ``dictionary_bytes`` gives at most that much.
    """
    src = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("draw"))
    sizes = {r["lang"]: r["b"] for r in src.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    if not sizes:
        return {}
    share = F.lit(0)
    for lang, b in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, 2 * dictionary_bytes / b)))).otherwise(share)
    drawn = src.where(F.col("draw") < share).select("lang", "draw", F.substring("text", 1, dictionary_bytes).alias("text")).distinct()  # copies share a draw
    got: dict[str, list[bytes]] = {lang: [] for lang in sizes}
    for r in sorted(drawn.collect(), key=lambda r: (r["draw"], r["text"])):
        got[r["lang"]].append(fold(r["text"]))
    missing = [lang for lang, texts in got.items() if not texts]
    if missing:  # a language of few, large texts may miss the draw: its first row by the same order
        for r in src.where(F.col("lang").isin(missing)).groupBy("lang").agg(
                F.min_by(F.substring("text", 1, dictionary_bytes), "draw").alias("text")).collect():
            got[r["lang"]].append(fold(r["text"]))
    # copies teach nothing; the largest language comes first
    return {lang: b" ".join(dict.fromkeys(got[lang]))[:dictionary_bytes] for lang in sorted(got, key=lambda x: (-sizes[x], x))}


_READY: dict[tuple, list] = {}


def _compressors(dictionaries: dict[str, bytes], level: int) -> list:
    key = (level, tuple((k, hash(v)) for k, v in dictionaries.items()))
    if key not in _READY:
        _READY.clear()
        made = []
        for body in dictionaries.values():
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _READY[key] = made
    return _READY[key]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predictor(spark, dictionaries: dict[str, bytes], level: int = LEVEL, min_margin: float = MIN_MARGIN):
    """Column function: text -> struct(lang_pred, score, accepted).

    Null texts, and texts without a letter, are ``und`` with score 0 and rejected. A tie goes
    to the language with the most learning text, with score 0, and is rejected. With one language there is no
    margin: it is accepted with score 1.
    """
    shared = spark.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        names = list(shared.value)
        packers = _compressors(shared.value, level)
        best, score = [], []
        for t in text:
            if t is None or not names or not has_letter(t):
                best.append(UND)
                score.append(0.0)
                continue
            raw = fold(t)
            chunks = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]
            sizes = [sum(len(p.compress(c)) for c in chunks) for p in packers]
            i = int(np.argmin(sizes))
            best.append(names[i])
            score.append(1 - sizes[i] / min(s for k, s in enumerate(sizes) if k != i) if len(sizes) > 1 else 1.0)
        out = pd.DataFrame({"lang_pred": best, "score": np.array(score, float)})
        out["accepted"] = (out["lang_pred"] != UND) & ((out["score"] >= min_margin) & (out["score"] > 0))
        return out

    return predict


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             dictionary_bytes: int = DICTIONARY_BYTES, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row (repeated rows each); an empty table gives no rows.

    Null texts and texts without a letter are ``und``; a very long text is compressed whole, chunk by chunk; rows with a null
    id are learnt from as ``learn`` says. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    predict = predictor(spark, fit_dictionaries(docs, learn, id_col, text_col, lang_col, dictionary_bytes), min_margin=min_margin)
    return docs.select(F.col(id_col).alias("doc_id"), (~F.coalesce(learn, F.lit(False))).alias("held_out"),
                       predict(F.col(text_col).cast("string")).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, learn: Column, **options) -> DataFrame:
    """The rows whose language is identified with a sufficient margin, all columns kept. Null, empty and letterless texts go;
    repeated rows are judged alike and each kept; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    margin = options.pop("min_margin", MIN_MARGIN)
    predict = predictor(spark, fit_dictionaries(docs, learn, **options), min_margin=margin)
    return docs.where(predict(F.col(options.get("text_col", "text")).cast("string"))["accepted"])
