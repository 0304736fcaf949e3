"""Cases that the operators once left out: skewed and missing ids, unaligned passages, replaced words, repeated units."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe_dropout, decontamination, language_id, quality, simhash


def test_op8_sample_is_bounded_under_one_key(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i % 50} " + "word " * 100) for i in range(6000)]
    src = spark.createDataFrame(rows, "_id long, text string").repartition(4)
    drawn = quality.training_sample(src, 6000, 600).select("shard", F.octet_length("text").alias("n"), "draw").collect()
    assert 500 <= len(drawn) <= 600 and len({r["draw"] for r in drawn}) == len(drawn)
    shards = np.bincount([r["shard"] for r in drawn], minlength=quality.SHARDS)
    assert len(shards) == quality.SHARDS and shards.min() > 30 and shards.max() < 150
    few = quality.training_sample(src, 6000, 600, 50_000).agg(F.sum(F.octet_length("text"))).first()[0]
    assert 40_000 < few <= 50_000
    assert quality.training_sample(src, 6000, 600, 10).count() == 1


def test_op8_null_ids_do_not_make_the_sample(spark):
    rows = [(None if i % 3 == 0 else i, f"text {i} " + "word " * 20) for i in range(6000)]
    drawn = quality.training_sample(spark.createDataFrame(rows, "_id long, text string"), 6000, 900)
    numbers = [int(r["text"].split()[1]) for r in drawn.collect()]
    assert 0.25 < np.mean([i % 3 == 0 for i in numbers]) < 0.42


def best_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t))
        row = new
    return min(row)


def prose(rnd, size):
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(size)]
    return " ".join(words)


DEFAULTS = (decontamination.Q, decontamination.WINDOW, decontamination.STRIDE, decontamination.ERROR_SHARE, decontamination.MIN_CHARS,
            decontamination.WIDE, decontamination.WIDE_SHARE)


def test_op1_finds_unaligned_passages():
    rnd = random.Random(11)
    items = [(i, prose(rnd, 36)) for i in range(6)]
    index = decontamination.Index(items, *DEFAULTS)
    for size in (72, 76, 80, 84, 90):
        texts, owners = [], []
        for i, t in items:
            for _ in range(5):
                at = rnd.randint(1, len(t) - size - 1)
                passage = t[at:at + size].strip()
                if len(decontamination.folded(passage)) == size:
                    texts.append(f"{prose(rnd, 12)} {passage} {prose(rnd, 12)}")
                    owners.append(i)
        for i, hits in zip(owners, decontamination.find_windows(texts, index)):
            assert i in {h[0] for h in hits}


def test_op1_finds_replaced_words():
    rnd = random.Random(12)
    items = [(i, prose(rnd, 36)) for i in range(8)]
    texts = []
    for _, t in items:
        words = t.split()
        for k in range(4, len(words), 8):
            words[k] = prose(rnd, 1)
        texts.append(f"{prose(rnd, 20)} {' '.join(words)} {prose(rnd, 20)}")
    texts.append(prose(rnd, 200))
    index = decontamination.Index(items, *DEFAULTS)
    found = decontamination.find_windows(texts, index)
    assert [{h[0] for h in hits} for hits in found] == [*({i} for i, _ in items), set()]
    for (_, t), text, hits in zip(items, texts, found):
        allowed = int(decontamination.WIDE_SHARE * len(t))
        whole = [h for h in hits if h[3] - h[2] > decontamination.WINDOW + 3]
        assert best_edits(t, text) == min(h[4] for h in whole) <= allowed
        assert not [h for h in whole if best_edits(t, text[h[2]:h[3]]) > h[4]]


def test_op3_repeated_units_and_rows_vary():
    vocabulary = bpe_dropout.load_vocabulary()
    coder = bpe_dropout.Encoder(vocabulary, 0.2)
    text = " ".join(["international"] * 300)
    rows = [list(x) for x in coder.encode_all([text] * 40, list(range(40)))]
    assert len({tuple(x) for x in rows}) == 40
    assert all(bpe_dropout.decode(x, vocabulary) == text for x in rows)
    assert len({tuple(coder.encode(f"{'a ' * i}international")[-8:]) for i in range(60)}) > 8
    assert [list(bpe_dropout.Encoder(vocabulary, 0.2).encode(text, i)) for i in range(3)] == rows[:3]  # whatever the cache holds


def plain_encoding(text, variant, vocabulary, dropout, seed=bpe_dropout.SEED):
    """Unit by unit, every agenda run under its own draws; hashes in Python integers."""
    full, out = (1 << 64) - 1, []
    row = xxhash.xxh64_intdigest(f"{seed}:{variant}".encode())
    for place, unit in enumerate(bpe_dropout.UNITS.findall(" " + text) if text else []):
        own = (row + place * 0x9E3779B97F4A7C15) & full
        own = ((own ^ xxhash.xxh64_intdigest(unit.encode())) * 0xD6E8FEB86659FD93) & full
        own = ((own ^ (own >> 32)) * 0x9E3779B97F4A7C15) & full
        out += bpe_dropout.encode_unit(unit, vocabulary, own, dropout)
    return out


def test_op3_cached_pieces_are_those_of_the_agenda(monkeypatch):
    """What the cache of plain pieces and the merging in groups give is what each unit's agenda gives, for common, rare and long units."""
    vocabulary, rnd = bpe_dropout.load_vocabulary(), random.Random(5)
    words = ["".join(rnd.choice("theonirxas") for _ in range(rnd.randint(1, 20))) for _ in range(80)]
    words += ["日本語", "😀x", "naïveté", "▁", "a▁b", "\u0301e", "1234567", "x" * 39, "y" * 41, "z" * 300, "\n", "  ", "été" * 12]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(40)] + ["", " ", "▁▁"]
    for dropout in (0.0, 0.15, 0.6):
        want = [plain_encoding(t, i, vocabulary, dropout) for i, t in enumerate(texts)]
        for block, cache in ((200_000, 200_000), (7, 30)):
            monkeypatch.setattr(bpe_dropout, "BLOCK_UNITS", block)
            monkeypatch.setattr(bpe_dropout, "CACHE_UNITS", cache)
            monkeypatch.setattr(bpe_dropout, "LONG_TEXT", 1 << 20 if block > 7 else 50)
            coder = bpe_dropout.Encoder(vocabulary, dropout)
            assert [list(x) for x in coder.encode_all(texts, list(range(len(texts))))] == want
            assert all(bpe_dropout.decode(x, vocabulary) == t for x, t in zip(want, texts))


def test_keep_one_keeps_one_row_of_every_component(spark):
    """Repeated and missing ids, and columns named like helpers: every component keeps exactly one row."""
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue yellow black white"
    rows = [(1, a), (1, b), (5, b), (7, c), (5, c)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["text"] for r in got.collect()) == sorted([a, b, c])
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, a), (1, b), (5, c)}
    nameless = spark.createDataFrame([(None, a), (None, a + "!"), (None, b), (None, None), (None, "")], "doc_id long, text string")
    for name in ("_kept_id", "_fp", "fp", "at", "id", "h", "doc", "r", "label", "first", "a.b"):
        clash = simhash.keep_one(nameless.withColumn(name, F.lit(1)))
        assert clash.columns == ["doc_id", "text", name]
        kept = clash.collect()
        assert len({(r["text"] or "") for r in kept}) == len(kept) and {b} <= {r["text"] for r in kept} and sum(not r["text"] for r in kept) == 1


def test_op4_language_of_few_large_texts(spark):
    """A language whose texts all miss the draw still gets a dictionary; copies of a drawn row reach the driver once."""
    german = "der hund und die katze laufen durch den garten und sehen die vögel am himmel " * 45_000
    for i in (1, 2, 3):
        rows = [(j, "the dog and the cat run through the garden and see the birds", "en") for j in range(100, 140)] + [(i, german, "de")] * 2
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = language_id.fit_dictionaries(df, F.lit(True))
        assert set(got) == {"en", "de"} and all(isinstance(v, bytes) and 0 < len(v) <= language_id.DICTIONARY_BYTES for v in got.values())
        assert {r["lang_pred"] for r in language_id.identify(df, F.lit(True)).collect()} == {"en", "de"}


def test_op4_sizes_by_plain_compression(spark):
    """Prediction, score and rejection against sizes from plain zstandard calls; ties are rejected at any length."""
    import zstandard

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and the dog ran home", "en"), ("le chat est sur le tapis et le chien court", "fr")] * 15)]
    rows += [(50, "x", None), (51, "the", None), (52, "le chat", None), (53, "the cat et le chien", None), (54, "zzz " * 3000, None), (55, "12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    books = language_id.fit_dictionaries(df, F.lit(True))
    accepted = set()
    for r in language_id.identify(df, F.lit(True)).collect():
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        if not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        raw, sizes = language_id.fold(text), {}
        for lang, body in books.items():
            packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                              write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(packer.compress(raw[k:k + 2048])) for k in range(0, len(raw), 2048))
        first, second = sorted(sizes.values())
        assert sizes[r["lang_pred"]] == first and r["score"] == pytest.approx(1 - first / second)
        assert r["accepted"] == (first < second and 1 - first / second >= language_id.MIN_MARGIN)
        accepted.add(r["accepted"])
    assert accepted == {True, False}


def test_op8_against_plain_em_and_scorer(spark):
    """Votes, posterior and score of every row against a plain run of the same rules over the collected texts."""
    rnd, words = random.Random(4), "the cat sat on a mat and saw some birds in the old garden".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60))) for _ in range(60)]
    texts += ["### $$$ @@@ " * 20, "BUY NOW!! " * 30, "spam spam spam spam " * 30, "", None, "   ", "|||| ---- ==== " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labellers, weights, bias = quality.fit(df)
    counts = Counter(p for t in texts if (p := quality.pattern(t)))
    share, given, posterior = quality.fit_labellers(dict(counts))
    assert labellers[0] == pytest.approx(share) and labellers[2] == pytest.approx(posterior)
    for r in quality.classify(df).collect():
        t = texts[r["doc_id"]]
        assert r["votes"] == quality.pattern(t)
        if not (t or "").split():
            assert (r["weak_bad"], r["score"], r["accepted"]) == (None, 0.0, False)
            continue
        total = bias
        for i, x in zip(*quality.text_features(t)):
            total += float(np.float32(weights[i])) * x
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and r["weak_bad"] == pytest.approx(posterior[r["votes"]])


def test_op1_short_items_are_found_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "Then: what is 17 PLUS 25? Nobody knew."), (2, "what is 17 plus 255"), (3, "somewhat is 17 plus 25"), (4, ""), (5, None),
                                  (6, "What is 17 plus 25? what is 17 plus 25")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "What is 17 plus 25?"), (7, "What is 17 plus 25?"), (8, "?!"), (9, "nobody")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["doc_start"], r["doc_end"], r["edits"]) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == [(1, 7, 5, 23, 0), (1, 9, 24, 30, 0), (6, 7, 0, 18, 0), (6, 7, 19, 37, 0)]
    assert {r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()} == {2, 3, 4, 5}


def test_op10_versions_and_common_notices(spark):
    gnu = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by "
           "the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    want = {
        gnu.format("General", "2"): "gpl,gpl-2.0", gnu.format("General", "3"): "gpl,gpl-3.0", gnu.format("Lesser General", "2.1"): "gpl,lgpl-2.1",
        gnu.format("Affero General", "3"): "agpl-3.0,gpl", "Licensed under CC BY-NC 2.0": "cc-by,cc-by-nc-2.0", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0", "Licensed under CC0 1.0": "cc0-1.0", "Released under the MIT License": "mit",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "Licensed under the Apache License, Version 2.0": "apache-2.0", "This is free and unencumbered software released into the public domain.": "unlicense",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.": "bsd-3-clause", "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
        "This work is licensed under the GNU General Public License version 3": "gpl,gpl-3.0", "no licence here, only public words": "",
    }
    from tessera.llm import licenses

    rows = [(i, f"code line {i} x = 1 {t} end of it all y = 2") for i, t in enumerate(want)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(want.values())


def test_op2_token_counts_merge(monkeypatch):
    import pyarrow as pa

    from tessera.llm.lm_scoring import TokenCounts

    rnd, want, held = random.Random(2), Counter(), TokenCounts()
    for _ in range(30):
        part = Counter(rnd.randrange(50) - 25 for _ in range(40))
        want.update(part)
        held.add(np.array(list(part), np.int64), np.array(list(part.values()), np.int64))
        if rnd.random() < 0.3:
            assert held.merge() == len(want)
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])
    got = [(a, n) for b in held.batches(schema) for a, n in zip(b.column("a").to_pylist(), b.column("n").to_pylist())]
    assert got == sorted(want.items()) and not list(held.batches(schema))
