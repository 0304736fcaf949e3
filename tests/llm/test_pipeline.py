"""The corpus pipeline, stage by stage, against plain decisions over the collected documents."""

import math
import os

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe_dropout, decontamination, language_id, quality, simhash
from tessera.llm.common import remainder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def identified(books, text):
    if not text or not any(map(str.isalpha, text)):
        return False
    raw, sizes = language_id.fold(text), []
    for body in books.values():
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                          write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(raw[k:k + 2048])) for k in range(0, len(raw), 2048)))
    first, second = sorted(sizes)[:2]
    return first < second and 1 - first / second >= language_id.MIN_MARGIN


def good(weights, bias, text):
    if not (text or "").split():
        return False
    total = bias + sum(float(np.float32(weights[i])) * x for i, x in zip(*quality.text_features(text)))
    return 1 / (1 + math.exp(-total)) >= quality.MIN_SCORE


def fingerprint(text):
    """A bit is one if over half of the shingle hashes have it."""
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_of_components(rows):
    """Ids of the smallest documents of the components of all pairs at four or fewer differing bits."""
    prints = {i: fingerprint(t or "") for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {root(i) for i in ids}


def test_stages_against_plain_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    def after(name, df):
        out = stages[name](spark, df, SF)
        assert out.columns == columns
        kept = spark.createDataFrame(out.collect(), out.schema)
        return kept, texts(df), texts(kept)

    books = language_id.fit_dictionaries(docs, remainder(F.col("doc_id"), 4) != 2)
    kept, before, now = after("language_id", docs)
    assert set(now) == {i for i, t in before.items() if identified(books, t)} and len(now) > 150

    _, weights, bias = quality.fit(kept)
    kept, before, now = after("quality", kept)
    assert set(now) == {i for i, t in before.items() if good(weights, bias, t)} and len(now) > 100

    kept, before, now = after("near_duplicates", kept)
    assert set(now) == smallest_of_components(before) and len(now) < len(before)

    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    kept, before, now = after("decontamination", kept)
    spelt = {i: decontamination.spelt(decontamination.folded(t)) for i, t in before.items()}
    whole = [decontamination.spelt(decontamination.folded(t)) for _, t in items]
    verbatim = {i for i, t in spelt.items() if any(w[k:k + 80] in t for w in whole for k in range(0, max(1, len(w) - 79), 20))}
    assert verbatim and not verbatim & set(now)
    clean = {i for i, t in spelt.items() if not any(w[k:k + 12] in t for w in whole for k in range(0, max(1, len(w) - 11)))}
    assert clean <= set(now) and len(clean) > 50  # a document that shares no q-gram stays

    vocabulary = bpe_dropout.load_vocabulary()
    rows = stages["encoding"](spark, kept, SF).collect()
    assert {r["doc_id"] for r in rows} == set(now)
    assert all(r["lossless"] and bpe_dropout.decode(r["ids"], vocabulary) == now[r["doc_id"]] for r in rows)


def test_run_is_the_stages_one_after_the_other(spark):
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert out == {r["doc_id"] for r in docs.select("doc_id").collect()}
