import pytest
from pyspark.sql import functions as F

from golden import GOLDEN_BOTH_WAYS, GOLDEN_DICTIONARY
from tessera.functions.text import ENGLISH, TIBETAN
from tessera.operators.dictionary import (
    both_ways, dictionary_entries, forward_view, induce_dictionary, reverse_view, translate,
)
from tessera.sources.sinks import write_dictionary_tsv
from tessera.sources.text_files import read_dictionary, read_parallel_tsv, sample_pairs


def _write_sample(path):
    from tessera.sources.samples import SAMPLE_PAIRS

    with open(path, "w", encoding="utf-8") as f:
        for bo, en in SAMPLE_PAIRS:
            f.write(f"{bo}\t{en}\n")


def test_induce_matches_golden_file(spark, tmpdir_path):
    src = f"{tmpdir_path}/sample.txt"
    _write_sample(src)
    pairs = read_parallel_tsv(spark, src, ("bo", "en"))
    d = induce_dictionary(pairs, "bo", "en", TIBETAN, ENGLISH, ["line_no"])
    got = [(r.src, r.tgt) for r in d.orderBy("first_line_no", "first_pos").collect()]
    assert got == GOLDEN_DICTIONARY


def test_dictionary_round_trip_through_tsv(spark, tmpdir_path):
    pairs = sample_pairs(spark)
    d = induce_dictionary(pairs, "bo", "en", TIBETAN, ENGLISH, ["line_no"])
    out = f"{tmpdir_path}/dict"
    assert write_dictionary_tsv(d, out) == 21
    back = read_dictionary(spark, out)
    assert [(r.src, r.tgt) for r in back.orderBy("seq").collect()] == GOLDEN_DICTIONARY


def test_missing_dictionary_is_empty(spark, tmpdir_path):
    assert read_dictionary(spark, f"{tmpdir_path}/nope.txt").count() == 0


def test_both_ways_golden(spark):
    pairs = sample_pairs(spark)
    entries = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(GOLDEN_DICTIONARY)], "seq long, src string, tgt string")
    got = both_ways(pairs, entries, broadcast_rows=1000).orderBy("line_no").collect()
    assert [(r.line_no, r.translated_tgt, r.translated_src) for r in got] == GOLDEN_BOTH_WAYS
    # the shuffle-join path gives the same rows
    got2 = both_ways(pairs, entries, broadcast_rows=1).orderBy("line_no").collect()
    assert [(r.line_no, r.translated_tgt, r.translated_src) for r in got2] == GOLDEN_BOTH_WAYS


def test_reverse_view_counts(spark):
    entries = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(GOLDEN_DICTIONARY)], "seq long, src string, tgt string")
    rev = {r.tok: r.out for r in reverse_view(entries).collect()}
    assert len(rev) == 19 and rev["is"] == "ལ" and rev["good"] == "མཚན"


def test_translation_with_unmatchable_entries(spark):
    # multi-syllable keys never match single syllables; input is lower-cased, key "I" is not
    entries = spark.createDataFrame(
        [(0, "ཁྱེད་རང་", "you"), (1, "ག་འདྲས་", "how"), (2, "ཡོད", "are"), (3, "ང་", "I"), (4, "བདེ་པོ་", "well"), (5, "ཡིན", "am")],
        "seq long, src string, tgt string")
    df = spark.createDataFrame([(0, "ཁྱེད་རང་ག་འདྲས་ཡོད།", "I am well")], "id long, bo string, en string")
    f = translate(df, ["id"], "bo", forward_view(entries), TIBETAN, " ").first().translation
    r = translate(df, ["id"], "en", reverse_view(entries), ENGLISH, "").first().translation
    assert f == "[ཁྱེད] [རང] [ག] [འདྲས] are"
    assert r == "[i]ཡིནབདེ་པོ་"


def test_empty_text_survives(spark):
    entries = spark.createDataFrame([(0, "a", "b")], "seq long, src string, tgt string")
    df = spark.createDataFrame([(0, "།།"), (1, "")], "id long, bo string")
    got = {r.id: r.translation for r in translate(df, ["id"], "bo", forward_view(entries), TIBETAN, " ").collect()}
    assert got == {0: "", 1: ""}


def test_last_write_wins_and_entries_order(spark):
    pairs = spark.createDataFrame([(0, "a་a", "x y"), (1, "a", "z")], "line_no long, bo string, en string")
    d = induce_dictionary(pairs, "bo", "en", TIBETAN, ENGLISH, ["line_no"]).collect()
    assert [(r.src, r.tgt, r.first_line_no, r.first_pos) for r in d] == [("a", "z", 0, 0)]
    e = dictionary_entries(induce_dictionary(pairs, "bo", "en", TIBETAN, ENGLISH, ["line_no"]))
    assert forward_view(e).count() == 1


def test_broadcast_check_bounds_rows_and_bytes(spark):
    from tessera.plans.physical import bounded_broadcast

    view = spark.createDataFrame([("a", "x" * 100), ("b", "y")], "tok string, out string")
    assert bounded_broadcast(view, max_rows=2)[1] is True
    assert bounded_broadcast(view, max_rows=1)[1] is False
    assert bounded_broadcast(view, max_rows=10, max_bytes=50)[1] is False
    assert bounded_broadcast(view, max_rows=None)[1] is False


def test_large_dictionary_restricted_to_present_tokens(spark):
    # 500 entries exceed a 50-row limit, but only 3 tokens occur in the input: the restricted
    # view is broadcast, and the result equals the shuffle-join path.
    entries = spark.createDataFrame([(i, f"w{i}", f"t{i}") for i in range(500)], "seq long, src string, tgt string")
    df = spark.createDataFrame([(0, "w1 w2"), (1, "w3 zz"), (2, "")], "id long, text string")
    view = forward_view(entries)
    got = {r.id: r.translation for r in translate(df, ["id"], "text", view, ENGLISH, " ", broadcast_rows=50).collect()}
    assert got == {0: "t1 t2", 1: "t3 [zz]", 2: ""}
    plan = translate(df, ["id"], "text", view, ENGLISH, " ", broadcast_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    forced = {r.id: r.translation for r in translate(df, ["id"], "text", view, ENGLISH, " ", broadcast_rows=1).collect()}
    assert forced == got


def test_translation_gives_one_row_for_each_row(spark):
    """Null and repeated keys, equal rows: nothing is lost or merged."""
    view = spark.createDataFrame([("a", "x"), ("b", "y")], "tok string, out string")
    df = spark.createDataFrame([(1, "a"), (None, "a b"), (None, "b"), (2, "a"), (2, "b"), (2, "b"), (3, None), (4, "")], "id long, t string")
    got = sorted(((r.id, r.t, r.translation) for r in translate(df, ["id"], "t", view, ENGLISH, " ").collect()), key=repr)
    want = [(1, "a", "x"), (2, "a", "x"), (2, "b", "y"), (2, "b", "y"), (3, None, ""), (4, "", ""), (None, "a b", "x y"), (None, "b", "y")]
    assert got == sorted(want, key=repr)


def test_round_trip_gives_one_row_for_each_row(spark):
    from tessera.operators.translate import DictionaryModel, round_trip

    there = DictionaryModel(spark.createDataFrame([("a", "x"), ("b", "y")], "tok string, out string"), ENGLISH, ENGLISH)
    back = DictionaryModel(spark.createDataFrame([("x", "a")], "tok string, out string"), ENGLISH, ENGLISH)
    df = spark.createDataFrame([(1, "a b"), (None, "b"), (1, "a b"), (2, "c")], "id long, text string")
    got = sorted((tuple(r) for r in round_trip(df, there, back, ["id"]).collect()), key=repr)
    assert got == sorted([(1, "a b", "x y", "a [y]"), (None, "b", "y", "[y]"), (1, "a b", "x y", "a [y]"), (2, "c", "[c]", "[[c]]")], key=repr)


def test_back_translation_learns_no_unknown_token(spark, tmp_path):
    from tessera.operators.translate import back_translation

    par = spark.createDataFrame([(0, 0, "one two", "un deux")], "o1 long, o2 long, a_text string, b_text string")
    mono_a = spark.createDataFrame([(0, "one stranger [kept]")], "id long, text string")
    mono_b = spark.createDataFrame([(0, "un zz")], "id long, text string")
    back_translation(spark, par, mono_a, mono_b, ENGLISH, ENGLISH, rounds=2, out_dir=str(tmp_path))
    for direction in ("a-b", "b-a"):
        for i in (1, 2):
            keys = {r.tok for r in spark.read.parquet(f"{tmp_path}/models/{direction}/iteration_{i}").collect()}
            assert not [k for k in keys if k.startswith("[")] and keys


def _rounds_input(spark):
    par = spark.createDataFrame([(0, 0, "one two", "un deux"), (0, 2, "two one", "deux une")], "o1 long, o2 long, a_text string, b_text string")
    mono_a = spark.createDataFrame([(0, "one stranger two"), (1, "two two")], "id long, text string")
    mono_b = spark.createDataFrame([(0, "un zz deux"), (1, "")], "id long, text string")
    return par, mono_a, mono_b


def test_back_translation_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    """A run stopped in round 2, before or after the data of a step is there, ends with the rows of an undisturbed run."""
    from tessera.operators import translate as tr

    def rows(out):
        return sorted(tuple(r) for r in tr.back_translation(spark, *_rounds_input(spark), ENGLISH, ENGLISH, rounds=3, out_dir=str(out)).collect())

    want = rows(tmp_path / "whole")
    once = tr.written_once

    class Stop(Exception):
        pass

    for stop_at, with_data in (("models/b-a/iteration_2", False), ("synthetic/iteration=2/direction=b-a", True)):
        made = []

        def stopping(sp, out_dir, name, make):
            if name == stop_at:
                if with_data:  # the data is written, its commit is not
                    make().limit(0).write.mode("overwrite").parquet(f"{out_dir}/{name}")
                raise Stop
            return once(sp, out_dir, name, make)

        def counting(sp, out_dir, name, make):
            return once(sp, out_dir, name, lambda: made.append(name) or make())

        out = tmp_path / stop_at.replace("/", "-")
        monkeypatch.setattr(tr, "written_once", stopping)
        with pytest.raises(Stop):
            rows(out)
        monkeypatch.setattr(tr, "written_once", counting)
        assert rows(out) == want
        assert made[0] == stop_at and not [n for n in made if "iteration=1" in n or "iteration_1" in n or "states" in n]
        monkeypatch.setattr(tr, "written_once", once)


def test_dictionary_state_merges(spark):
    """The state of all pairs is the merge of the states of any parts, in any order."""
    from tessera.operators.dictionary import align_tokens, dictionary_state, merge_states

    pairs = spark.createDataFrame([(i, f"a b{i % 3} c", f"x{i} y{i % 5} z") for i in range(12)], "line_no long, bo string, en string")

    def state(df):
        return dictionary_state(align_tokens(df, ENGLISH.tokens(F.col("bo")), ENGLISH.tokens(F.col("en")), ["line_no"]), ["line_no"])

    want = sorted(map(str, state(pairs).collect()))
    parts = [state(pairs.where(F.col("line_no") % 3 == k)) for k in (2, 0, 1)]
    assert sorted(map(str, merge_states(*parts).collect())) == want
    assert sorted(map(str, merge_states(merge_states(parts[0], parts[1]), parts[2], state(pairs.where("false"))).collect())) == want


def test_joined_lookup_spreads_a_long_row(spark):
    """A row with most tokens is cut into segments that are dealt out; equal rows, null keys and empty rows keep their places."""
    from tessera.operators.dictionary import joined_tokens, map_tokens, usable_entries

    view = spark.createDataFrame([(f"w{i}", f"t{i}") for i in range(50)] + [("e", ""), ("n", None)], "tok string, out string")
    long_text = " ".join(f"w{i % 60}" for i in range(5000))
    df = spark.createDataFrame([(1, long_text), (None, "w1 e n"), (2, "w1"), (2, "w1"), (2, "w1"), (3, ""), (4, None)], "id long, text string")
    tokens = ENGLISH.tokens(F.col("text"))
    local = map_tokens(df, tokens, view, "out", missing_name="m")
    for limit in (1000, None):
        joined = joined_tokens(df, tokens, usable_entries(view), "out", lambda t: F.concat(F.lit("["), t, F.lit("]")), limit, "m", segment=64)
        assert sorted(map(str, joined.collect())) == sorted(map(str, local.collect()))
    plan = joined._jdf.queryExecution().toString()
    assert "_seg" in plan


def test_lookup_by_either_way_agrees(spark):
    view = spark.createDataFrame([("a", "x"), ("b", "y")], "tok string, out string")
    df = spark.createDataFrame([(1, "a"), (None, "a b"), (2, "b"), (2, "b"), (3, None), (4, "")], "id long, t string")
    got = [sorted(map(str, translate(df, ["id"], "t", view, ENGLISH, " ", local_rows=n).collect())) for n in (0, 10)]
    assert got[0] == got[1]


def test_joined_lookup_ships_distinct_tokens_of_blocks(spark):
    """Rows in many small blocks, rows of exactly a block and longer ones: values are those of the plain lookup, and what
    meets the view are the distinct tokens of a block."""
    from tessera.operators.dictionary import joined_tokens, usable_entries

    known = {f"w{i}": f"t{i}" for i in range(0, 40, 2)}
    view = spark.createDataFrame(list(known.items()), "tok string, out string")
    texts = [" ".join(f"w{(i * k) % 45}" for i in range(1, k + 1)) for k in range(0, 30)] * 3 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "tok long, text string").repartition(3)
    for joiner in (None, " "):
        out = joined_tokens(df, ENGLISH.tokens(F.col("text")), usable_entries(view), "out", lambda t: F.concat(F.lit("["), t, F.lit("]")), None, "m",
                            segment=16, joiner=joiner)
        rows = out.collect()
        assert len(rows) == len(texts)
        for r in rows:
            words = (texts[r.tok] or "").split()
            want = [known.get(w, f"[{w}]") for w in words]
            assert r.text == texts[r.tok] and r.out == (want if joiner is None else " ".join(want)) and r.m == [w not in known for w in words]
    assert "keys=[_block" in out._jdf.queryExecution().toString()


def test_a_view_of_a_large_vocabulary_is_held_by_the_tasks(spark):
    """Rows stay where they are for a view of 250,000 entries: nothing but the dealing-out is shuffled."""
    view = spark.range(250_000).select(F.concat(F.lit("w"), F.col("id")).alias("tok"), F.col("id").cast("string").alias("out"))
    df = spark.createDataFrame([(1, "w1 w249999 x"), (2, None)], "id long, t string")
    out = translate(df, ["id"], "t", view, ENGLISH, " ")
    assert sorted((r.id, r.translation) for r in out.collect()) == [(1, "1 249999 [x]"), (2, "")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
