"""The registered queries on the small tables: contracts, brute force, held-out accuracy, planted cases."""

import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.decontamination import find_leaks, without_leaks
from tessera.llm.queries import ORACLE, QUERIES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def lower(t):
    return (t or "").encode().lower().decode()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op2_base_and_counts(spark, texts):
    count = Counter()
    for i, t in texts.items():
        if remainder(i, 5) != 1:
            count.update(w for w in SPACE.split(lower(t)) if w)
            count[None] += 1
    total, low = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    got = {r["doc_id"]: r for r in QUERIES["op2_context_mixing"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = [w for w in SPACE.split(lower(t)) if w] + [None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (remainder(i, 5) == 1, len(words), total)
        assert r["n_known"] == sum(w in count for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10(count[w] + 0.5) - low for w in words), rel=1e-9)
        assert r["score"] < 0


def test_op4_held_out_accuracy(spark):
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op4_language_id"](spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.95


def test_op5_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    df = QUERIES["op5_chat_format"](spark, SF)
    res = con.execute(ORACLE["op5_chat_format"])
    cols = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_op5_snapshots_collapse(spark):
    from tessera.llm.chat import format_chats

    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")]
    rows = [(c, t, *turns[t]) for c, n in ((1, 2), (2, 5), (3, 3), (4, 5)) for t in range(n)]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "x")] + [(6, t, "user", f"t{t % 3}") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chats(df).collect()
    assert {(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got} == {(2, 5, 2), (5, 2, 1), (6, 700, 1)}
    parts = sorted((r["part"], r["chat"]) for r in got if r["conv_id"] == 6)
    assert [p for p, _ in parts] == [0, 1, 2]
    assert "".join(c for _, c in parts) == "".join(f"<|im_start|>user\nt{t % 3}<|im_end|>\n" for t in range(700))


def components(fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_op6_against_all_pairs(spark, texts):
    import xxhash

    def fingerprint(t):
        w = [x for x in SPACE.split(lower(t)) if x]
        grams = [w[i:i + 4] for i in range(len(w) - 3)] if len(w) > 4 else [w] if w else []
        h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = sorted(texts)
    fps = [fingerprint(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, SF).collect()}
    assert got == want


def test_op6_crowded_cells(spark):
    """A large group of near copies, in cells dealt in blocks: components stay exact."""
    from tessera.llm.simhash import components as of_links, link_fingerprints

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4), dtype=np.uint64)) for b in base for _ in range(120)]
    fps = np.unique(np.concatenate([near, rng.integers(0, 2**63, 50, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = components([int(x) for x in fps])
    for block in (30, 50_000):
        labels = {r["node"]: r["label"] for r in of_links(link_fingerprints(df, 4, cell_block=block)).collect()}
        got = [labels.get(int(x), int(x)) for x in fps.view(np.int64)]
        assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_op7_contract(spark, texts):
    rows = QUERIES["op7_jump_shards"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8_finds_the_bad(spark):
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    got = {r["doc_id"]: r["accepted"] for r in QUERIES["op8_weak_quality"](spark, SF).collect()}
    right = [got[i] == bool(q) for i, q in truth.items()]
    kept = [got[i] for i, q in truth.items() if q]
    assert np.mean(right) > 0.9 and np.mean(kept) > 0.97


def test_op9_recall(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {}
    for r in QUERIES["op9_ann"](spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    place = {v: i for i, v in enumerate(ids)}
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]])
        mine = got[ids[q]]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        assert all(abs(x - unit[place[v]] @ unit[q]) < 1e-9 for v, x in mine.values())
        hits.append(len(best & {v for v, _ in mine.values()}) / 5)
    assert np.mean(hits) >= 0.9


def test_op9_ties_and_copies(spark):
    from tessera.llm.ann import nearest_neighbours

    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)] + [(500, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 500: [0, 1, 2, 3, 4]}


def test_op10_base(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r["doc_id"]: r for r in QUERIES["op10_licenses"](spark, SF).collect()}
    for i, t in texts.items():
        w = word.findall(lower(t))
        places, labels = [], set()
        for p, label in phrases.items():
            p = p.split()
            at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_op10_notices(spark):
    from tessera.llm.licenses import scan_licenses

    rows = [(0, "x y. Licensed under the Apache License, Version 2.0. z"), (1, "Released under the MIT License."),
            (2, "the license of the version under the apache"), (3, None),
            (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that:")]
    rows += [(10 + i, "plain words and nothing else here") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(df).collect()}
    assert (got[0], got[1], got[2], got[3], got[4], got[10]) == ("apache-2.0", "mit", "", "", "bsd", "")


def test_planted_passages_go_and_clean_documents_stay(spark):
    item = "The committee met on a rainy Tuesday to weigh seventeen proposals about harbour lights and their upkeep in winter."
    typo = item.replace("seventeen", "seventen").replace("harbour", "harbor")
    rows = [(0, f"Some words first. {item} Some words after."), (1, f"intro {item.upper()} outro"), (2, f"x {typo} y"), (3, "harbour lights in winter"),
            (4, "A clean text about the weather and the sea, and nothing that any test would ask."), (5, item[:100])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in find_leaks(docs, bench).collect()} == {0, 1, 2, 5}
    assert [r["doc_id"] for r in without_leaks(docs, bench).orderBy("doc_id").collect()] == [3, 4]
    assert {r["doc_id"] for r in find_leaks(docs, bench.union(bench.select(F.lit(8), F.lit("another item that is long enough to be looked for"))),
                                            block_chars=60).collect()} == {0, 1, 2, 5}


def test_pipeline(spark, texts):
    out = corpus_pipeline.run(spark, SF)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert 0.6 * len(texts) < len(rows) < len(texts) and all(r["lossless"] for r in rows.values())
    from tessera.llm.queries import QUERIES as Q

    groups = {r["doc_id"]: r["component_id"] for r in Q["op6_simhash"](spark, SF).collect()}
    assert len({groups[i] for i in rows}) == len(rows)
    leaks = {r["doc_id"] for r in Q["op1_qgram_decontamination"](spark, SF).collect()}
    assert not leaks & set(rows)
