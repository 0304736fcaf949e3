"""Conversation repair, token counts and vector codes against SQL twins, brute force and the public library."""

import hashlib
import heapq
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm.conversation_repair import FILL, FINISH, KEEP, ORACLE_SQL as REPAIR_SQL, repair_conversations, table_of, vectors, walk
from tessera.llm.queries import ORACLE, QUERIES
from tessera.llm.token_counts import CACHE_BYTES, ChunkCounts, count_tokens, load_model, model_path, spans
from tessera.llm.vector_codes import CLAMP, ENTRIES, PARTS, ROUNDS, Tree, _levels, assign, compress_vectors, exact_kind, tree_order
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
EMPTY_HASH = hashlib.sha256().hexdigest()


@tables
@pytest.mark.parametrize("name, table", [("op11_conversation_repair", "conversations"), ("op13_vector_codes", "embeddings")])
def test_query_against_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert df.columns == cols
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


# ---------------------------------------------------------------- conversation repair
def cheapest(codes):
    """Least (cost, audit) by a search over (cost, audit) itself."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(codes) and q in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", i, FILL[q]))
        if i < len(codes):
            initial, must, cut = codes[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if not must:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, FILL[q]))
                if q in KEEP.get(initial, {}):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, KEEP[initial][q]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.booleans(), st.booleans()), max_size=9), st.integers(1, 4))
def test_repair_kernel_against_search(codes, size):
    want = cheapest(codes)
    edits, state = walk(codes, FINISH, 0, True)
    assert (vectors(codes, FINISH)[0][0], "".join(e[0] for e in edits)) == want and state in (0, 3)
    # by blocks: tables chain to the vectors, ends chain to the states
    blocks = [codes[i:i + size] for i in range(0, len(codes), size)] or [[]]
    ends, end = [], FINISH
    for b in reversed(blocks):
        ends.insert(0, end)
        t = table_of(b)
        end = tuple(min(t[4 * q + e] + end[e] for e in range(4)) for q in range(4))
    state, audit = 0, ""
    for b, e in zip(blocks, ends):
        step, state = walk(b, e, state, b is blocks[-1])
        audit += "".join(x[0] for x in step)
    assert (end[0], audit) == want


def repaired(df, **options):
    return {r["conv_id"]: r for r in repair_conversations(df, **options).collect()}


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_repair_against_sql_on_hard_rows(spark):
    """Null and repeated turns, null ids, unknown roles, blank texts; blocks of a few rows, too."""
    rng = random.Random(3)
    rows = [(c or None, rng.choice([None, t, t, t + rng.randint(0, 3)]), rng.choice(["user", "assistant", "system", None, "", "tool"]),
             rng.choice(["hi.", "yes", "  ", None, "", "a?", "b!  \n", "c", "é…", "x" * 50_000 + "."])) for c in range(25) for t in range(rng.choice([1, 3, 20, 60]))]
    df = spark.createDataFrame(rows + rows[:5], CONVERSATION).withColumn("block", F.lit(1)).withColumn("place", F.lit("x")).withColumn("n", F.lit(2))
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = rows_of(["conv_id"], [(str(r),) for r in con.execute(REPAIR_SQL).fetchall()])
    for min_block in (1, 3, 256):
        got = repair_conversations(df, damage=True, min_block=min_block)
        assert rows_of(["conv_id"], [(str(tuple(r)),) for r in got.collect()]) == want
    assert repair_conversations(df.where("false"), damage=True).count() == 0


def test_repair_values(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "system", "S."), (2, 1, "assistant", "A."), (3, 0, "user", " "), (4, 0, "user", "cut"),
            (4, 4, "user", "cut"), (5, None, "assistant", "x."), (5, None, "user", "y.")]
    got = repaired(spark.createDataFrame(rows, CONVERSATION))
    assert {k: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for k, r in got.items()} == {
        1: (0, 0, 0, 0, 0, 0, "KK"), 2: (0, 0, 0, 0, 1, 2, "KIK"), 3: (0, 1, 0, 0, 0, 3, "D"), 4: (3, 0, 1, 1, 1, 6, "DD"), 5: (0, 0, 0, 0, 0, 2 * 2, "IKKI")}
    assert got[2]["repaired_sha256"] == hashlib.sha256("system:S.\nuser:\nassistant:A.".encode()).hexdigest()
    assert got[3]["repaired_sha256"] == got[4]["repaired_sha256"] == EMPTY_HASH


def test_repair_of_one_long_conversation(spark):
    """A conversation with nearly all rows is spread over blocks and gives what one block gives."""
    df = spark.range(6000).select(F.lit(7).cast("long").alias("conv_id"), (F.col("id") * 2).alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("t"), F.col("id") % 2500, F.when(F.col("id") % 7 == 0, "").otherwise(".")).alias("text"))
    df = df.unionByName(spark.createDataFrame([(8, 0, "user", "a."), (9, 0, None, None)], CONVERSATION))
    a, b = repaired(df, min_block=64), repaired(df, min_block=1 << 20)
    assert a == b and set(a) == {7, 8, 9} and a[7]["duplicate"] > 1000 and a[7]["gaps"] == 5999


# ---------------------------------------------------------------- token counts
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model_path())


def counted(counts, text):
    return sum(sum(counts[c] for c in chunks) for chunks in spans(text))


MARKS = "abAB'stremvld .,!?<|>endoftxʼéÉé́ßİıΣσς  \x85\x1c\n\t1٣½Ⅷ日😀‍ͅ"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet=MARKS, max_size=30),
                 st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "don't", " ", "It's", "x"]), max_size=8).map("".join)))
def test_token_counts_against_library(text):
    counts = ChunkCounts(load_model(model_path()), 2000)  # a cache that is emptied again and again
    assert counted(counts, text) == len(library_once().encode(text, add_special_tokens=False).ids)


_LIBRARY = []


def library_once():
    if not _LIBRARY:
        _LIBRARY.append(library())
    return _LIBRARY[0]


def test_common_signs_against_library():
    """Every sign that is cut without the library, alone, doubled, after letters and marks."""
    from tessera.llm.token_counts import COMMON

    counts, signs = ChunkCounts(load_model(model_path()), 1 << 20), [c for c in map(chr, range(0x21, 0x180)) if COMMON(c)]
    assert len(signs) > 310
    for c in signs:
        for text in (c, c + c, f"a{c}B", f"É{c}'s", f"!{c}1", f"{c}'LL{c}"):
            assert counted(counts, text) == len(library_once().encode(text, add_special_tokens=False).ids), text


@tables
def test_op12_against_library(spark):
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op12_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        n = len(library_once().encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_token_counts_hard_rows(spark):
    long_text, unbroken = "Some words, again and again; " * 80_000, "ab1é" * 30_000
    rows = [(1, None), (1, ""), (None, "one two"), (None, None), (2, long_text), (3, unbroken), (4, "x"), (4, "x"), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("z")).withColumn("n_bytes", F.lit(0))
    got = sorted((tuple(r) for r in count_tokens(df, limit=1).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library_once().encode(t or "", add_special_tokens=False).ids), n > 1) for i, t in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(df.where("false")).count() == 0


def test_cache_stays_within_its_bytes():
    counts = ChunkCounts(load_model(model_path()), 20_000)
    for i in range(1000):
        counts[f"w{i}"]
        assert counts.held <= 20_000
    assert len(counts) < 200 and CACHE_BYTES <= 64 << 20


# ---------------------------------------------------------------- vector codes
@pytest.mark.parametrize("most, kind", [(500, np.int64), (3, np.int64), (CLAMP, object)])
@pytest.mark.parametrize("n, k, w", [(1, 1, 3), (7, 5, 2), (1000, 16, 8), (3000, 16, 1), (900, 11, 4), (30, 16, 8)])
def test_dual_tree_against_plain_assignment(most, kind, n, k, w):
    rng = np.random.default_rng(n)
    x, e = rng.integers(-most, most + 1, (n, w)), rng.integers(-most, most + 1, (k, w))
    if most == 500:  # clusters, so that whole nodes are assigned
        x[: n // 2] = x[: n // 2] // 50 + (np.arange(n // 2) % 3)[:, None] * 200
    assert exact_kind(x, e) == kind
    x, e = x.astype(kind), e.astype(kind)
    order, codes = tree_order(x, _levels(n)), np.zeros(n, np.int64)
    sums, counts = assign(Tree(x[order], _levels(n)), e, codes)
    plain = ((x[:, None] - e[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (plain[order] == codes).all()
    for j in range(k):
        assert counts[j] == (plain == j).sum() and (sums[j] == x[plain == j].sum(axis=0)).all()


def plain_codes(rows):
    """Contract in plain Python over (vec_id, vector, label)."""
    size = max(len(v) for _, v, _ in rows)
    width = -(-size // PARTS)
    cut = [[int(np.floor(np.float64(x) * 4096)) for x in v] + [0] * (PARTS * width - len(v)) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, cut[i]))[:ENTRIES]
    out, all_entries = [[] for _ in rows], []
    for p in range(PARTS):
        parts = [c[p * width:(p + 1) * width] for c in cut]
        book = [parts[i] for i in first]
        def near(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
        for _ in range(ROUNDS):
            own = [near(x)[1] for x in parts]
            book = [[sum(x[d] for x, o in zip(parts, own) if o == j) // own.count(j) for d in range(width)] if j in own else e for j, e in enumerate(book)]
        for o, x in zip(out, parts):
            o.append(near(x))
        all_entries += [c for e in book for c in e]
    errors = [sum(d for d, _ in o) for o in out]
    digest = hashlib.sha256(",".join(map(str, all_entries)).encode()).hexdigest()
    return [(i, label, "".join(f"{j:02x}" for _, j in o), e, sum(f for f, r in zip(errors, rows) if r[2] == label), digest)
            for (i, _, label), o, e in zip(rows, out, errors)]


def test_vector_codes_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    good = [(i, [rng.uniform(-1, 1) for _ in range(20)], rng.choice([None, 1, 2])) for i in range(60)]
    good += [(None, [0.5] * 20, 1), (None, [0.25] * 20, None), (3, good[3][1], 2), (70, [1.0] * 9, 1), (71, [], None), (72, [1e6, -1e6] * 10, 7)] + good[:4]
    bad = [(80, None, 1), (81, [nan] * 20, 1), (82, [inf] + [0.0] * 19, 1), (83, [None] * 20, 1), (84, [-inf], None)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).withColumn("n", F.lit("x")).withColumn("v", F.lit(0))
    got = [tuple(r) for r in compress_vectors(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_codes(good)))
    few = [(5, [1.0, 2.0], None), (4, [1.0, 2.0], None), (6, [0.0, -2.0], 3)]
    got = compress_vectors(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_codes(few)))
    none = compress_vectors(df.where("vec_id = 80"))
    assert none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0


def test_vector_codes_many_labels(spark):
    """Hot labels are joined by broadcast, the others by key; the sums agree."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[((F.col("id") * (7 + j)) % 101 / 50 - 1).cast("float") for j in range(8)]).alias("embedding"),
                                  F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 1500).cast("int").alias("label"))
    rows = compress_vectors(df).collect()
    sums = {}
    for r in rows:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert len(rows) == 3000 and all(r["label_error"] == sums[r["label"]] for r in rows)
