import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import twins
from tessera.functions.porter import stem
from tessera.functions.tok13a import tokenize_13a
from tessera.operators.metrics.edit import corpus_edit_rate, with_edit_stats
from tessera.operators.metrics.meteor import corpus_meteor, with_meteor
from tessera.operators.metrics.ngrams import BLEU_STAT_COLS, CHRF_STAT_COLS, sum_stats, with_bleu_stats, with_chrf_stats
from tessera.operators.metrics.scores import bleu_exp, bleu_unsmoothed, chrf, sentence_bleu

WORDS = "the a cat dog sat on mat , . ran fast slow big small red".split()


def _pairs(n, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        h = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))
        r = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))
        out.append((i, h, r))
    # fixed edge rows: identical, disjoint, short, empty prediction
    out += [(n, "the cat sat on the mat", "the cat sat on the mat"), (n + 1, "red red", "blue green"),
            (n + 2, "a b", "a b c"), (n + 3, "", "some words here")]
    return out


@pytest.fixture(scope="module")
def hub(spark):
    return spark.createDataFrame(_pairs(60), "id long, prediction string, reference string")


def test_bleu_stats_and_scores(spark, hub):
    per_row = with_bleu_stats(hub, ["id"], tokenize_13a(F.col("prediction")), tokenize_13a(F.col("reference")))
    rows = {r.id: r for r in per_row.collect()}
    tot_m, tot_t, hl, rl = [0] * 4, [0] * 4, 0, 0
    for i, h, r in _pairs(60):
        m, t, a, b = twins.bleu_stats(twins.tok13a(h), twins.tok13a(r))
        got = rows[i]
        assert [got[f"match_{n}"] for n in range(1, 5)] == m and [got[f"total_{n}"] for n in range(1, 5)] == t
        tot_m = [x + y for x, y in zip(tot_m, m)]
        tot_t = [x + y for x, y in zip(tot_t, t)]
        hl, rl = hl + a, rl + b
    agg = sum_stats(per_row, BLEU_STAT_COLS).select(bleu_unsmoothed().alias("u"), bleu_exp().alias("s")).first()
    assert agg.u == pytest.approx(twins.bleu_unsmoothed(tot_m, tot_t, hl, rl), abs=1e-9)
    assert agg.s == pytest.approx(twins.bleu_exp(tot_m, tot_t, hl, rl), abs=1e-9)


def test_sentence_bleu_twin(spark, hub):
    got = {r.id: r.b for r in hub.select("id", sentence_bleu(tokenize_13a(F.col("prediction"), True),
                                                              tokenize_13a(F.col("reference"), True)).alias("b")).collect()}
    for i, h, r in _pairs(60):
        m, t, a, b = twins.bleu_stats(twins.tok13a(h, True), twins.tok13a(r, True))
        assert got[i] == pytest.approx(twins.bleu_exp(m, t, a, b, effective_order=True), abs=1e-9), (h, r)
    assert got[60] == pytest.approx(100.0)  # identical texts
    assert got[61] == 0.0 and got[63] == 0.0  # no shared word; empty prediction


def test_bleu_identity_and_bounds(spark):
    df = spark.createDataFrame([(0, "one two three four five", "one two three four five")], "id long, p string, r string")
    st = sum_stats(with_bleu_stats(df, ["id"], tokenize_13a(F.col("p")), tokenize_13a(F.col("r"))), BLEU_STAT_COLS)
    row = st.select(bleu_unsmoothed().alias("u"), bleu_exp().alias("s")).first()
    assert row.u == pytest.approx(1.0) and row.s == pytest.approx(100.0)
    short = spark.createDataFrame([(0, "a b", "a b")], "id long, p string, r string")
    st2 = sum_stats(with_bleu_stats(short, ["id"], tokenize_13a(F.col("p")), tokenize_13a(F.col("r"))), BLEU_STAT_COLS)
    assert st2.select(bleu_unsmoothed().alias("u")).first().u == 0.0  # fewer than 4 tokens


def test_chrf_twin(spark, hub):
    st = sum_stats(with_chrf_stats(hub, ["id"], F.col("prediction"), F.col("reference")), CHRF_STAT_COLS)
    got = st.select(chrf().alias("c")).first().c
    tot = [[0, 0, 0] for _ in range(6)]
    for _, h, r in _pairs(60):
        for k, s in enumerate(twins.chrf_stats(h, r)):
            tot[k] = [x + y for x, y in zip(tot[k], s)]
    assert got == pytest.approx(twins.chrf(tot), abs=1e-9)


def test_word_edits_native_matches_python(spark, hub):
    st = {r.id: (r.edits, r.ref_len) for r in with_edit_stats(hub, ["id"]).collect()}
    for i, h, r in _pairs(60):
        assert st[i] == (twins.levenshtein(h.lower().split(), r.lower().split()), len(r.split()))
    wer = corpus_edit_rate(hub, ["id"], name="wer").first()
    assert wer.wer == pytest.approx(round(100.0 * wer.edits / wer.ref_len, 6))


def test_porter_published_examples():
    cases = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
             "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
             "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
             "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
             "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
             "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
             "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr",
             "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
             "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun",
             "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
             "controll": "control", "roll": "roll", "generalizations": "gener"}
    assert {w: stem(w) for w in cases} == cases


def test_meteor_row():
    assert twins.meteor_row([], ["a"]) == 0.0 and twins.meteor_row(["a"], ["b"]) == 0.0
    # identical 4 words: one chunk, penalty 0.5 * (1/4)^3
    assert twins.meteor_row(list("abcd"), list("abcd")) == pytest.approx(1 - 0.5 * (1 / 4) ** 3)
    # stem stage: "cats" ~ "cat"
    p, r = 1.0, 1.0
    assert twins.meteor_row(["cats"], ["cat"]) == pytest.approx((1 - 0.5) * (p * r / (0.9 * p + 0.1 * r)))
    # two chunks out of 4 matches
    v = twins.meteor_row(["a", "b", "x", "c", "d"], ["a", "b", "c", "d"])
    p, r = 4 / 5, 1.0
    assert v == pytest.approx((1 - 0.5 * (2 / 4) ** 3) * p * r / (0.9 * p + 0.1 * r))


def test_meteor_corpus(spark, hub):
    rows = _pairs(60) + [(90, "", "a b"), (91, "a", ""), (92, "cats cat cat dogs", "cat dog cats cat"), (93, "a a b a", "a b a a a")]
    df = spark.createDataFrame(rows, "id long, prediction string, reference string")
    want = {i: twins.meteor_row(h.lower().split(), r.lower().split()) for i, h, r in rows}
    for x in with_meteor(df, ["id"]).collect():
        assert x.meteor_exact_stem == pytest.approx(want[x.id], abs=1e-9)
    got = corpus_meteor(df, ["id"]).first()
    assert got.meteor_exact_stem == pytest.approx(sum(want.values()) / len(want), abs=1e-6)
    assert not math.isnan(got.meteor_exact_stem)


def test_engines_agree(spark, hub):
    h, r = tokenize_13a(F.col("prediction")), tokenize_13a(F.col("reference"))
    a = with_bleu_stats(hub, ["id"], h, r, engine="arrow").orderBy("id").collect()
    b = with_bleu_stats(hub, ["id"], h, r, engine="jvm").orderBy("id").collect()
    assert a == b
    c = with_chrf_stats(hub, ["id"], F.col("prediction"), F.col("reference"), engine="arrow").orderBy("id").collect()
    d = with_chrf_stats(hub, ["id"], F.col("prediction"), F.col("reference"), engine="jvm").orderBy("id").collect()
    assert c == d


SF01 = "/root/testdata/sf0.01"


@pytest.mark.skipif(not __import__("os").path.isdir(SF01), reason="driver tables not present")
def test_survey_regression_statistics(spark):
    """SURVEY 7.6: 13a n-gram statistics of the sf0.01 pairs (assistant text against user text)."""
    from tessera.plans.derive import conversation_pairs

    pairs = conversation_pairs(spark, SF01)
    for engine in ("arrow", "jvm"):
        st = sum_stats(with_bleu_stats(pairs, [], tokenize_13a(F.col("tgt")), tokenize_13a(F.col("src")), engine=engine),
                       BLEU_STAT_COLS).first()
        assert [st[f"match_{n}"] for n in range(1, 5)] == [2923, 199, 20, 9]
        assert [st[f"total_{n}"] for n in range(1, 5)] == [42541, 42308, 42075, 41842]
        assert (st.hyp_len, st.ref_len) == (42541, 8728)


# ---------------------------------------------------------------- the pruned filter and the one-pass report
def test_bleu_bound_is_never_below_the_score():
    """The bounds from lengths and from shared tokens against the counted score, on random and on near-equal token lists."""
    from tessera.operators.metrics.ngrams import COUNTED, bleu_bound, bleu_counts_above, clipped

    rnd = random.Random(11)
    decided = Counter()
    for i in range(4000):
        r = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 14))]
        h = [w for w in r if rnd.random() > 0.1] if i % 2 else [rnd.choice(WORDS) for _ in range(rnd.randint(0, 14))]
        m, t, a, b = twins.bleu_stats(h, r)
        score = twins.bleu_exp(m, t, a, b, effective_order=True) / 100
        assert bleu_bound(a, b, min(a, b)) >= bleu_bound(a, b, clipped(Counter(h), Counter(r))) - 1e-12 >= score - 2e-12, (h, r)
        for threshold in (0.0, 0.3, 0.7, 1.0):
            how, stats = bleu_counts_above(h, r, threshold)
            decided[how] += 1
            if how == COUNTED:
                assert stats[:4] == m and stats[4:8] == t
            else:
                assert score < threshold
    assert min(decided.values()) > 100 and len(decided) == 3


def test_filter_decisions_and_scores(spark):
    from tessera.operators.filters import decided_pairs, filter_decisions, quality_filter

    rows = [(1, "the cat sat on the mat", "x", "the cat sat on the mat"), (2, "the cat sat on the mat", "x", "the"), (3, "a b c d", "x", "e f g h"),
            (4, "été", "abc", "no"), (5, "été", "a" * 40, "no"), (None, "same words here now", "y", "same words here now"), (6, None, "z", None), (7, "", "", "")]
    df = spark.createDataFrame(rows, "id long, orig string, trans string, back string")
    got = {r.id: (r.decided_by, r.kept) for r in decided_pairs(df, ["id"]).collect()}
    assert got == {1: ("n-grams", True), 2: ("lengths", False), 3: ("shared tokens", False), 4: ("ratio", True), 5: ("ratio", False),
                   None: ("n-grams", True), 6: ("ratio", True), 7: ("ratio", False)}
    assert {r.id for r in quality_filter(df, ["id"]).collect()} == {1, 4, None, 6}
    report = {r.decided_by: (r.n_rows, r.n_kept) for r in filter_decisions(df, ["id"]).collect()}
    assert report == {"n-grams": (2, 2), "lengths": (1, 0), "shared tokens": (1, 0), "ratio": (4, 2)}


def test_evaluation_report_in_one_pass(spark, hub):
    """Every level equals the single metrics over its rows; the plan reads the examples once and shuffles sums only."""
    from tessera.operators.metrics.meteor import corpus_meteor
    from tessera.operators.report import bleu_by_length, corpus_scores, error_analysis, evaluation_report, full_report

    hub = hub.withColumn("source", F.concat_ws(" ", "reference", "prediction"))
    hub = hub.unionByName(spark.createDataFrame([(100, "ends with a dash-\n ", "ends with a dash-", "x"), (101, None, "gone", "y"), (102, "Kept", None, None)],
                                                "id long, prediction string, reference string, source string"))
    examples = hub.withColumn("direction", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    report = evaluation_report(examples, 0xC0, 0xFF)
    got = {(r.level, r.direction, r.bucket): r for r in report.collect()}
    assert len([k for k in got if k[0] == "all"]) == 1 and sum(k[0] == "direction" for k in got) == 2
    for key, part in ((("all", None, None), hub), (("direction", "odd", None), hub.where("id % 2 = 1"))):
        one, scores = got[key], corpus_scores(part).first()
        assert (one.bleu, one.bleu_smoothed, one.chrf) == (scores.bleu, sum_and_score(part), scores.chrf)
        assert one.wer == corpus_edit_rate(part, ["id"]).first().wer
        meteor = corpus_meteor(part, ["id"]).first()
        assert (one.meteor_exact, one.meteor_exact_stem) == (meteor.meteor_exact, meteor.meteor_exact_stem)
    complete = hub.where("prediction IS NOT NULL AND reference IS NOT NULL")
    whole = evaluation_report(complete.withColumn("direction", F.lit("d"))).where("level = 'all'").first()
    errors = error_analysis(complete).first()
    assert (whole.avg_length_diff, whole.untranslated_percentage, whole.n_rows) == (errors.avg_length_diff, errors.untranslated_percentage, errors.n_rows)
    buckets = {r.bucket: (r.bleu, r["count"], r.percentage) for r in bleu_by_length(hub).collect()}
    assert buckets == {b.bucket: (b.bleu, b["count"], b.percentage) for b in full_report(hub, ["id"]).first().length_analysis}
    plan = evaluation_report(examples, 0xC0, 0xFF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" in plan


def sum_and_score(part):
    st = sum_stats(with_bleu_stats(part, ["id"], tokenize_13a(F.col("prediction"), True), tokenize_13a(F.col("reference"), True)), BLEU_STAT_COLS)
    return st.select(F.round(bleu_exp(), 6).alias("b")).first().b


def test_meteor_exact_only(spark):
    df = spark.createDataFrame([(1, "running dogs ran", "runs dogs ran"), (2, "a b", "a b"), (3, "", "x"), (4, None, None)], "id long, prediction string, reference string")
    got = {r.id: (r.meteor_exact, r.meteor_exact_stem) for r in with_meteor(df, ["id"]).collect()}
    assert got[1][0] == pytest.approx((1 - 0.5 * (1 / 2) ** 3) * 2 / 3) and got[1][1] > got[1][0]
    assert got[2][0] == pytest.approx(1 - 0.5 * (1 / 2) ** 3) and got[3] == got[4] == (0.0, 0.0)


def plain_ter(h, r, max_dist=50):
    """The rule of the row-based TER, pair by pair over word lists."""
    h, r = list(h), list(r)
    d, shifts = twins.levenshtein(h, r), 0
    while d > 1:
        best = None
        for i in range(len(h)):
            for j in range(max(0, i - max_dist), min(len(r), i + max_dist + 1)):
                if i == j or h[i] != r[j] or (i and j and h[i - 1] == r[j - 1]):
                    continue
                n = 1
                while i + n < len(h) and j + n < len(r) and h[i + n] == r[j + n]:
                    n += 1
                block, rest = h[i:i + n], h[:i] + h[i + n:]
                to = {min(j, len(rest))}
                before = [k + 1 for k in range(max(0, j - n - 1), len(rest)) if j and rest[k] == r[j - 1]]
                to |= {0} if j == 0 else set(before[:1])
                after = [k for k in range(max(0, j - n), len(rest)) if j + n < len(r) and rest[k] == r[j + n]]
                to |= {len(rest)} if j + n == len(r) else set(after[:1])
                for t in to:
                    if t != i and abs(t - i) <= max_dist:
                        new = rest[:t] + block + rest[t:]
                        key = (twins.levenshtein(new, r), -n, i, t, new)
                        best = key if best is None or key < best else best
        if best is None or best[0] >= d:
            break
        d, h, shifts = best[0], best[4], shifts + 1
    return d + shifts


def test_ter_by_rows(spark, hub):
    """Hand-worked shifts, and every row against the same rule over word lists; never above the plain edit distance."""
    from tessera.operators.metrics.ter import corpus_ter, with_ter_edits

    hand = [(0, "c d a b", "a b c d", 1), (1, "", "a b", 2), (2, "a b", "a b", 0), (3, "x a b c y", "a b c x y", 1), (4, "b c x x a", "a b c", 3),
            (5, None, "a", 1), (6, "a", None, 1), (7, "q q q x y a b c d", "a b c d q q q x y", 1), (8, " ".join(["w"] * 60 + ["z"]), " ".join(["z"] + ["w"] * 60), 1)]
    df = spark.createDataFrame([x[:3] for x in hand], "id long, prediction string, reference string")
    got = {r.id: (r.edits, r.ref_len) for r in with_ter_edits(df, ["id"]).collect()}
    assert {i: e for i, (e, _) in got.items()} == {x[0]: x[3] for x in hand} and got[6][1] == 0
    rnd = random.Random(8)
    pairs = []
    for i in range(60):
        r = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 14))]
        cut = sorted(rnd.sample(range(len(r) + 1), min(3, len(r) + 1)))
        h = r[cut[-1]:] + r[cut[0]:cut[-1]] + r[:cut[0]] if i % 2 else [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 14))]
        pairs.append((i, " ".join(h), " ".join(r)))
    df = spark.createDataFrame(pairs, "id long, prediction string, reference string")
    rows = {r.id: r.edits for r in with_ter_edits(df, ["id"], max_dist=6).collect()}
    for i, h, r in pairs:
        assert rows[i] == plain_ter(h.split(), r.split(), 6) <= twins.levenshtein(h.split(), r.split()), (h, r)
    one = corpus_ter(hub, ["id"]).first()
    assert one.edits <= corpus_edit_rate(hub, ["id"]).first().edits and one.ter == pytest.approx(round(100.0 * one.edits / one.ref_len, 6))


def test_ter_rounds_broadcast_no_exploded_words(spark):
    """The words of all pairs are many more bytes than their table: no round may collect them at the driver."""
    from tessera.operators.metrics.ter import best_shifts

    pairs = spark.createDataFrame([(0, "abc", "bca", 2, 0), (1, "xy", "xy", 0, 0)], "_row long, h string, r string, d int, shifts int")
    best = best_shifts(pairs)
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString()
    assert [(r._row, r.h, r.d, r.shifts) for r in best.collect()] == [(0, "bca", 0, 1)]
