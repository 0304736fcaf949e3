"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver tables (or data Spark derives from them). ``ORACLE`` holds the DuckDB twin
of each query that SQL can express; the others are checked against Python twins
in the unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as tx
from tessera.functions.tok13a import tokenize_13a
from tessera.operators.dictionary import dictionary_entries, forward_view, reverse_view, translate
from tessera.operators.metrics.ngrams import BLEU_STAT_COLS, CHRF_STAT_COLS, sum_stats, with_bleu_stats, with_chrf_stats
from tessera.operators.metrics.scores import bleu_exp, bleu_unsmoothed, chrf, r6
from tessera.plans import oracle as Q
from tessera.plans.derive import (
    PAIR_KEYS, SRC_SCRIPT, TGT_SCRIPT, both_direction_examples, conversation_pairs, pair_dictionary,
    scored_examples, table, translated_pairs,
)
from tessera.plans.physical import dense_row_number
from tessera.sources.web import article_paragraphs, page_paragraphs, parsed_paragraphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Stand-in script range for the driver tables (Latin-1 letters).
LO, HI = 0x00C0, 0x00FF


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- 2.3 scalar functions
@register("syllables", f"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, {Q.marks('text')} AS t FROM documents)""")
def q_syllables(spark, d):
    t = SRC_SCRIPT.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                               F.array_join(t, "|").alias("tokens"))


@register("words_lower", f"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, {Q.words_lower('text')} AS t FROM documents)""")
def q_words_lower(spark, d):
    t = tx.words_lower(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                               F.array_join(t, "|").alias("tokens"))


@register("swap_pairs", f"""
WITH {Q.PAIRS}
SELECT conv_id, turn, tgt AS src, src AS tgt FROM pairs""")
def q_swap_pairs(spark, d):
    p = conversation_pairs(spark, d)
    return p.select(*PAIR_KEYS, F.col("tgt").alias("src"), F.col("src").alias("tgt"))


@register("normalise_text", f"""
SELECT doc_id, lang,
  CASE WHEN lang = 'fr' THEN {Q.strip(f"regexp_replace(replace(nfc_normalize(text), '.', '. '), '{Q.WS}+', ' ', 'g')")}
       ELSE text END AS text_norm
FROM documents""")
def q_normalise_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "lang", tx.normalise_if(F.col("text"), F.col("lang"), "fr", ".").alias("text_norm"))


@register("latin_only", r"""
SELECT doc_id, coalesce(regexp_matches(text, '\A[a-zA-Z\s\x0b\p{P}0-9]+\z'), false) AS is_latin
FROM documents""")
def q_latin_only(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.latin_only(F.col("text")).alias("is_latin"))


@register("contains_script", r"""
SELECT doc_id, coalesce(regexp_matches(text, '[\x{00C0}-\x{00FF}]'), false) AS has_script FROM documents""")
def q_contains_script(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.contains_script(F.col("text"), LO, HI).alias("has_script"))


@register("length_ratio", f"""
WITH {Q.PAIRS}
SELECT conv_id, turn, length(src) AS n_chars_src, length(tgt) AS n_chars_tgt,
       round(length(tgt)::DOUBLE / greatest(1, length(src)), 6) AS ratio,
       (length(tgt)::DOUBLE / greatest(1, length(src))) BETWEEN 0.5 AND 2.0 AS ratio_ok
FROM pairs""")
def q_length_ratio(spark, d):
    p = conversation_pairs(spark, d)
    ratio = tx.length_ratio(F.col("tgt"), F.col("src"))
    return p.select(*PAIR_KEYS, tx.char_length("src").cast("long").alias("n_chars_src"),
                    tx.char_length("tgt").cast("long").alias("n_chars_tgt"),
                    r6(ratio).alias("ratio"), ratio.between(0.5, 2.0).alias("ratio_ok"))


@register("length_buckets", f"""
WITH {Q.PAIRS}
SELECT conv_id, turn, len({Q.split_ws('src')}) AS n_words,
       CASE WHEN len({Q.split_ws('src')}) <= 5 THEN 'short (1-5 words)'
            WHEN len({Q.split_ws('src')}) <= 15 THEN 'medium (6-15 words)' ELSE 'long (16+ words)' END AS bucket
FROM pairs""")
def q_length_buckets(spark, d):
    p = conversation_pairs(spark, d)
    n = tx.word_count(F.col("src"))
    return p.select(*PAIR_KEYS, n.cast("long").alias("n_words"), tx.length_bucket(n).alias("bucket"))


# ---------------------------------------------------------------- 2.1 sources over tables
@register("paragraphs_per_topic", f"""
WITH p AS (
  SELECT source, doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT source, doc_id, string_split(text, {Q.NL}) AS parts FROM documents)),
f AS (SELECT * FROM p WHERE len({Q.split_ws('text')}) > 10 AND NOT starts_with(text, '=='))
SELECT source, doc_id, pos, text FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS rn FROM f) WHERE rn <= 100""")
def q_paragraphs_per_topic(spark, d):
    docs = table(spark, d, "documents")
    return article_paragraphs(docs, "source", "doc_id", "text", sep="\n", per_topic=100, max_texts=None).select(
        "source", "doc_id", "pos", "text")


_PAGE_SQL = r"""
WITH x AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'),
      '(?i)<p(\s[^>]*)?>', chr(1) || 'P', 'g'),
      '(?i)</p>|</article>|</body>', chr(1) || 'X', 'g') AS h FROM pages),
pc AS (SELECT page_id, unnest(string_split(h, chr(1))) AS piece, generate_subscripts(string_split(h, chr(1)), 1) - 1 AS pos FROM x),
tx AS (
  SELECT page_id, pos, trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(substring(piece, 2), '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
    '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text
  FROM pc WHERE starts_with(piece, 'P'))
SELECT page_id, pos, text FROM tx WHERE length(text) > 0 AND regexp_matches(text, '[\x{00C0}-\x{00FF}]')"""


@register("page_paragraphs", _PAGE_SQL)
def q_page_paragraphs(spark, d):
    return page_paragraphs(table(spark, d, "pages"), LO, HI, max_texts=None)


_VOID_SQL = "['area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr']"
_ELEMENT_SQL = "</?[a-zA-Z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>"
_SPAN_TEXT = "array_to_string(texts[s + 1:e + 1], '')"
for _from, _to in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&middot;", "chr(183)"),
                   ("&copy;", "chr(169)"), ("&amp;", "'&'")):
    _SPAN_TEXT = f"replace({_SPAN_TEXT}, '{_from}', {_to})"


@register("parsed_paragraphs", rf"""
WITH RECURSIVE x AS (
  SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[!?][^>]*>', '', 'g') AS h FROM pages),
c AS (SELECT page_id, regexp_extract_all(h, '{_ELEMENT_SQL}') AS tags, string_split(regexp_replace(h, '{_ELEMENT_SQL}', chr(1), 'g'), chr(1)) AS texts FROM x),
ev AS MATERIALIZED (
  SELECT page_id, i, lower(regexp_extract(tag, '^</?([a-zA-Z][^\s/>]*)', 1)) AS name, starts_with(tag, '</') AS closes, ends_with(tag, '/>') AS bare
  FROM (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM c)),
st AS (
  SELECT page_id, 0::BIGINT AS i, []::STRUCT(name VARCHAR, i BIGINT)[] AS stack, []::STRUCT(s BIGINT, e BIGINT)[] AS done FROM c
  UNION ALL
  SELECT page_id, i, CASE WHEN closes AND lvl > 0 THEN stack[1:lvl - 1] WHEN NOT closes AND NOT bare AND NOT list_contains({_VOID_SQL}, name)
                          THEN list_append(stack, {{'name': name, 'i': i}}) ELSE stack END,
         CASE WHEN closes AND lvl > 0 THEN list_transform(list_filter(stack[lvl:], lambda y: y.name = 'p'), lambda y: {{'s': y.i, 'e': i - 1}})
              WHEN NOT closes AND bare AND name = 'p' THEN [{{'s': i, 'e': i - 1}}] ELSE [] END
  FROM (SELECT ev.*, st.stack, coalesce(len(st.stack) + 1 - list_position(list_reverse(list_transform(st.stack, lambda y: y.name)), ev.name), 0) AS lvl
        FROM st JOIN ev ON ev.page_id = st.page_id AND ev.i = st.i + 1)),
sp AS (
  SELECT page_id, y.s AS s, y.e AS e FROM (SELECT page_id, unnest(done) AS y FROM st)
  UNION ALL
  SELECT page_id, y.i AS s, n AS e FROM (SELECT st.page_id, unnest(stack) AS y, len(tags) AS n FROM st JOIN c ON c.page_id = st.page_id AND st.i = len(c.tags)) WHERE y.name = 'p'),
tx AS (
  SELECT sp.page_id, row_number() OVER (PARTITION BY sp.page_id ORDER BY s) - 1 AS pos, {Q.strip(_SPAN_TEXT)} AS text FROM sp JOIN c ON c.page_id = sp.page_id)
SELECT page_id, pos, text FROM tx WHERE regexp_matches(text, '[\x{{00C0}}-\x{{00FF}}]')""")
def q_parsed_paragraphs(spark, d):
    """S8 with paragraphs nested as a parser nests them."""
    return parsed_paragraphs(table(spark, d, "pages"), LO, HI)


# ---------------------------------------------------------------- 2.5 joins / 2.7 dictionary
@register("line_zip", """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents WHERE lang = 'en'),
     b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents WHERE lang = 'fr')
SELECT a.line_no, a.doc_id AS doc_a, b.doc_id AS doc_b FROM a JOIN b USING (line_no)""")
def q_line_zip(spark, d):
    docs = table(spark, d, "documents")
    a = dense_row_number(docs.where(F.col("lang") == "en").select("doc_id"), ["doc_id"], "line_no")
    b = dense_row_number(docs.where(F.col("lang") == "fr").select("doc_id"), ["doc_id"], "line_no")
    return a.withColumnRenamed("doc_id", "doc_a").join(b.withColumnRenamed("doc_id", "doc_b"), "line_no").select(
        "line_no", "doc_a", "doc_b")


@register("induce_dictionary", f"""
WITH {Q.PAIRS}, {Q.DICT}
SELECT src, tgt, first_conv_id, first_turn, first_pos FROM dict""")
def q_induce_dictionary(spark, d):
    return pair_dictionary(conversation_pairs(spark, d))


@register("reverse_dictionary", f"""
WITH {Q.PAIRS}, {Q.DICT}, {Q.REV}
SELECT tok, out FROM rev""")
def q_reverse_dictionary(spark, d):
    return reverse_view(dictionary_entries(pair_dictionary(conversation_pairs(spark, d))))


@register("translate_corpus", f"""
WITH {Q.PAIRS}, {Q.DICT}, {Q.FWD}, {Q.translate_cte('tr', 'src', Q.marks, 'fwd', ' ')}
SELECT conv_id, turn, translation FROM tr""")
def q_translate_corpus(spark, d):
    pairs = conversation_pairs(spark, d)
    view = forward_view(dictionary_entries(pair_dictionary(pairs)))
    return translate(pairs, PAIR_KEYS, "src", view, SRC_SCRIPT, TGT_SCRIPT.joiner).select(*PAIR_KEYS, "translation")


@register("translate_reverse", f"""
WITH {Q.PAIRS}, {Q.DICT}, {Q.REV}, {Q.translate_cte('tr', 'tgt', Q.words_lower, 'rev', ' ')}
SELECT conv_id, turn, translation FROM tr""")
def q_translate_reverse(spark, d):
    pairs = conversation_pairs(spark, d)
    view = reverse_view(dictionary_entries(pair_dictionary(pairs)))
    return translate(pairs, PAIR_KEYS, "tgt", view, TGT_SCRIPT, SRC_SCRIPT.joiner).select(*PAIR_KEYS, "translation")


@register("translate_both", f"""
WITH {Q.DIRS}
SELECT f.conv_id, f.turn, f.source AS original_src, f.reference AS actual_tgt,
       f.prediction AS translated_tgt, r.prediction AS translated_src
FROM dirs f JOIN dirs r ON f.conv_id = r.conv_id AND f.turn = r.turn
WHERE f.direction = 'src-tgt' AND r.direction = 'tgt-src'""")
def q_translate_both(spark, d):
    return translated_pairs(spark, d)


# ---------------------------------------------------------------- 2.8 metrics
def _bleu_row_stats(hub: DataFrame, keys: list[str], rstrip: bool = False) -> DataFrame:
    return with_bleu_stats(hub, keys, tokenize_13a(F.col("prediction"), rstrip), tokenize_13a(F.col("reference"), rstrip))


_KEYS = "conv_id, turn"
_STAT_OUT = ", ".join(f"{c}::BIGINT AS {c}" for c in BLEU_STAT_COLS)


@register("bleu_corpus", f"""
WITH {Q.HUB}, {Q.bleu_row_stats('hub', _KEYS)}, agg AS ({Q.sum_stats_sql('st')})
SELECT round({Q.bleu_unsmoothed_sql()}, 6) AS bleu, {_STAT_OUT} FROM agg""")
def q_bleu_corpus(spark, d):
    st = sum_stats(_bleu_row_stats(scored_examples(spark, d), PAIR_KEYS), BLEU_STAT_COLS)
    return st.select(r6(bleu_unsmoothed()).alias("bleu"), *[F.col(c).cast("long").alias(c) for c in BLEU_STAT_COLS])


@register("bleu_corpus_smoothed", f"""
WITH {Q.HUB}, {Q.bleu_row_stats('hub', _KEYS, rstrip=True)}, agg AS ({Q.sum_stats_sql('st')})
SELECT round({Q.bleu_exp_sql()}, 6) AS bleu FROM agg""")
def q_bleu_corpus_smoothed(spark, d):
    st = sum_stats(_bleu_row_stats(scored_examples(spark, d), PAIR_KEYS, rstrip=True), BLEU_STAT_COLS)
    return st.select(r6(bleu_exp()).alias("bleu"))


@register("bleu_sentence", f"""
WITH {Q.HUB}, {Q.bleu_row_stats('hub', _KEYS, rstrip=True)}
SELECT conv_id, turn, round({Q.bleu_exp_sql(effective_order=True)}, 6) AS bleu FROM (
  SELECT conv_id, turn, {', '.join(f'{c}::DOUBLE AS {c}' for c in BLEU_STAT_COLS)} FROM st)""")
def q_bleu_sentence(spark, d):
    st = _bleu_row_stats(scored_examples(spark, d), PAIR_KEYS, rstrip=True)
    return st.select(*PAIR_KEYS, r6(bleu_exp(effective_order=True)).alias("bleu"))


@register("bleu_by_length", f"""
WITH {Q.HUB}, {Q.bleu_row_stats('hub', _KEYS)},
b AS (SELECT st.*, CASE WHEN len({Q.split_ws('h.source')}) <= 5 THEN 'short (1-5 words)'
            WHEN len({Q.split_ws('h.source')}) <= 15 THEN 'medium (6-15 words)' ELSE 'long (16+ words)' END AS bucket
      FROM st JOIN hub h USING (conv_id, turn)),
agg AS ({Q.sum_stats_sql('b', 'bucket')})
SELECT bucket, round({Q.bleu_unsmoothed_sql()}, 6) AS bleu, n_rows AS count,
       round(100.0 * n_rows / sum(n_rows) OVER (), 6) AS percentage FROM agg""")
def q_bleu_by_length(spark, d):
    from tessera.operators.report import bleu_by_length

    return bleu_by_length(scored_examples(spark, d))


@register("bleu_by_direction", f"""
WITH {Q.DIRS}, {Q.bleu_row_stats('dirs', 'direction, conv_id, turn', rstrip=True)}, agg AS ({Q.sum_stats_sql('st', 'direction')})
SELECT direction, round({Q.bleu_exp_sql()}, 6) AS bleu, n_rows AS count FROM agg""")
def q_bleu_by_direction(spark, d):
    from tessera.operators.report import bleu_by_direction

    return bleu_by_direction(both_direction_examples(spark, d))


@register("chrf_corpus", f"""
WITH {Q.HUB}, {Q.chrf_stats_sql('hub', _KEYS)}, agg AS ({Q.sum_chrf_sql('cst')})
SELECT round({Q.chrf_sql()}, 6) AS chrf FROM agg""")
def q_chrf_corpus(spark, d):
    hub = scored_examples(spark, d)
    st = sum_stats(with_chrf_stats(hub, [], F.col("prediction"), F.col("reference")), CHRF_STAT_COLS)
    return st.select(r6(chrf()).alias("chrf"))


@register("error_analysis", f"""
WITH {Q.HUB}
SELECT round(avg(len({Q.split_ws('prediction')}) - len({Q.split_ws('reference')})), 6) AS avg_length_diff,
       round(100.0 * avg(CASE WHEN regexp_matches(prediction, '[\\x{{00C0}}-\\x{{00FF}}]') THEN 1 ELSE 0 END), 6) AS untranslated_percentage,
       count(*) AS n_rows
FROM hub""")
def q_error_analysis(spark, d):
    from tessera.operators.report import error_analysis

    return error_analysis(scored_examples(spark, d), LO, HI)


# ---------------------------------------------------------------- 2.10 splits, caps, batches
from tessera.operators.split import (  # noqa: E402
    batches, epoch_batches, exact_split, first_per_group, ceil_share_size, train_first_size, val_first_size,
)


def _split_sql(size_expr: str, first: str, second: str) -> str:
    return f"""
WITH n AS (SELECT count(*)::DOUBLE AS n FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, CASE WHEN rn <= (SELECT {size_expr} FROM n) THEN '{first}' ELSE '{second}' END AS split FROM r"""


@register("split_train_first", _split_sql("floor(n * 0.9::DOUBLE)", "train", "validation"))
def q_split_train_first(spark, d):
    return exact_split(table(spark, d, "documents").select("doc_id"), "doc_id", 42, train_first_size(0.9))


@register("split_val_first", _split_sql("floor(n * (1.0::DOUBLE - 0.9::DOUBLE))", "validation", "train"))
def q_split_val_first(spark, d):
    return exact_split(table(spark, d, "documents").select("doc_id"), "doc_id", 42, val_first_size(0.9),
                       ("validation", "train"))


@register("split_test_ceil", _split_sql("ceil(0.1::DOUBLE * n)", "test", "train"))
def q_split_test_ceil(spark, d):
    return exact_split(table(spark, d, "documents").select("doc_id"), "doc_id", 42, ceil_share_size(0.1), ("test", "train"))


@register("cap_per_language", """
SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 500""")
def q_cap_per_language(spark, d):
    return first_per_group(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 500)


@register("head_examples", f"""
WITH {Q.DIRS}
SELECT direction, conv_id, turn, source, reference, prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY direction ORDER BY conv_id, turn) AS rn FROM dirs) WHERE rn <= 10""")
def q_head_examples(spark, d):
    ex = both_direction_examples(spark, d)
    return first_per_group(ex, ["direction"], PAIR_KEYS, 10).select(
        "direction", *PAIR_KEYS, "source", "reference", "prediction")


@register("batches", """
SELECT doc_id, rn - 1 AS row_no, (rn - 1) // 16 AS batch_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)""")
def q_batches(spark, d):
    return batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 16)


@register("epoch_shuffle", """
SELECT epoch, doc_id, rn - 1 AS row_no, (rn - 1) // 32 AS batch_id FROM (
  SELECT e.epoch, doc_id, row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42:' || e.epoch || ':' || doc_id), doc_id) AS rn
  FROM documents, (SELECT unnest([0, 1]) AS epoch) e)""")
def q_epoch_shuffle(spark, d):
    return epoch_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 42, 2, 32)


# ---------------------------------------------------------------- P14 / P15 encodings
from tessera.operators.encode import build_vocabulary, encode_fixed, encode_longest  # noqa: E402


def _ids_str(c):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


@register("encode_fixed", f"""
WITH {Q.PAIRS},
tk AS (SELECT conv_id, turn, {Q.marks('src')} AS s, {Q.words_lower('tgt')} AS t FROM pairs),
vocab AS (SELECT tok, row_number() OVER (ORDER BY tok) + 1 AS id FROM (
  SELECT unnest(s) AS tok FROM tk UNION SELECT unnest(t) AS tok FROM tk)),
sx AS (SELECT conv_id, turn, unnest(s) AS tok, generate_subscripts(s, 1) AS pos FROM tk),
tx AS (SELECT conv_id, turn, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM tk),
sid AS (SELECT conv_id, turn, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM sx LEFT JOIN vocab v USING (tok) GROUP BY ALL),
tid AS (SELECT conv_id, turn, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM tx LEFT JOIN vocab v USING (tok) GROUP BY ALL),
j AS (SELECT p.conv_id, p.turn, coalesce(a.ids, []::BIGINT[]) AS s, coalesce(b.ids, []::BIGINT[]) AS t
      FROM pairs p LEFT JOIN sid a USING (conv_id, turn) LEFT JOIN tid b USING (conv_id, turn))
SELECT conv_id, turn,
  array_to_string(list_resize(s[1:128], 128, 0), ' ') AS input_ids,
  array_to_string(list_resize(list_resize([]::BIGINT[], least(len(s), 128), 1), 128, 0), ' ') AS attention_mask,
  array_to_string(list_resize(t[1:128], 128, 0), ' ') AS labels
FROM j""")
def q_encode_fixed(spark, d):
    pairs = conversation_pairs(spark, d)
    st, tt = SRC_SCRIPT.tokens(F.col("src")), TGT_SCRIPT.tokens(F.col("tgt"))
    vocab = build_vocabulary(pairs.select(st.alias("t")), pairs.select(tt.alias("t")))
    enc = encode_fixed(pairs, PAIR_KEYS, st, tt, vocab, 128)
    return enc.select(*PAIR_KEYS, _ids_str("input_ids"), _ids_str("attention_mask"), _ids_str("labels"))


_NORM_SRC = Q.strip(f"regexp_replace(replace(nfc_normalize(src), '.', '. '), '{Q.WS}+', ' ', 'g')")


@register("encode_longest", f"""
WITH {Q.PAIRS},
tk AS (SELECT conv_id, turn, {Q.marks(_NORM_SRC)} AS s,
              (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS batch_id FROM pairs),
vocab AS (SELECT tok, row_number() OVER (ORDER BY tok) + 1 AS id FROM (SELECT DISTINCT unnest(s) AS tok FROM tk)),
sx AS (SELECT conv_id, turn, unnest(s) AS tok, generate_subscripts(s, 1) AS pos FROM tk),
sid AS (SELECT conv_id, turn, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM sx LEFT JOIN vocab v USING (tok) GROUP BY ALL),
j AS (SELECT k.conv_id, k.turn, k.batch_id, coalesce(a.ids, []::BIGINT[]) AS s FROM tk k LEFT JOIN sid a USING (conv_id, turn)),
m AS (SELECT *, max(least(len(s), 512)) OVER (PARTITION BY batch_id) AS blen FROM j)
SELECT conv_id, turn, batch_id,
  array_to_string(list_resize(s[1:blen], blen, 0), ' ') AS input_ids,
  array_to_string(list_resize(list_resize([]::BIGINT[], least(len(s), blen), 1), blen, 0), ' ') AS attention_mask
FROM m""")
def q_encode_longest(spark, d):
    pairs = conversation_pairs(spark, d)
    src = tx.normalise_script(F.col("src"), ".")
    b = batches(pairs.select(*PAIR_KEYS, src.alias("src_norm")), PAIR_KEYS, 16)
    toks = SRC_SCRIPT.tokens(F.col("src_norm"))
    vocab = build_vocabulary(b.select(toks.alias("t")))
    enc = encode_longest(b, PAIR_KEYS, toks, vocab, "batch_id", 512)
    return enc.select(*PAIR_KEYS, "batch_id", _ids_str("input_ids"), _ids_str("attention_mask"))


# ---------------------------------------------------------------- 2.7 / 2.9 reports
from tessera.operators.report import (  # noqa: E402
    best_so_far, corpus_profile, epoch_loss, final_best, logged_batches, numbered_batches, split_counts,
)


def metric_history(spark: SparkSession, d: str) -> DataFrame:
    """D12 stand-in: events as a training log (run = user, step = event id, day = epoch)."""
    ev = table(spark, d, "events")
    return ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"),
                     F.to_date("ts").alias("epoch"), F.col("value").alias("loss"), F.col("value").alias("bleu"))


@register("corpus_profile", f"""
WITH {Q.PAIRS}
SELECT count(*) AS n_rows, round(avg(length(src)), 6) AS avg_chars_src, round(avg(length(tgt)), 6) AS avg_chars_tgt FROM pairs""")
def q_corpus_profile(spark, d):
    return corpus_profile(conversation_pairs(spark, d))


@register("split_counts", """
WITH n AS (SELECT count(*)::DOUBLE AS n FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents),
s AS (SELECT CASE WHEN rn <= (SELECT floor(n * 0.9::DOUBLE) FROM n) THEN 'train' ELSE 'validation' END AS split FROM r)
SELECT split, count(*) AS n_rows FROM s GROUP BY split""")
def q_split_counts(spark, d):
    return split_counts(q_split_train_first(spark, d))


@register("epoch_loss", """
SELECT user_id AS run, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS epoch, round(avg(value), 6) AS mean_loss, count(*) AS n_batches
FROM events GROUP BY ALL""")
def q_epoch_loss(spark, d):
    out = epoch_loss(metric_history(spark, d))
    return out.withColumn("epoch", F.date_format("epoch", "yyyy-MM-dd"))


@register("logged_batches", """
WITH b AS (SELECT user_id AS run, CAST(ts AS DATE) AS epoch, event_id AS step, value AS loss,
                  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS batch_idx FROM events)
SELECT run, strftime(epoch, '%Y-%m-%d') AS epoch, step, batch_idx, loss FROM b WHERE batch_idx % 3 = 0""")
def q_logged_batches(spark, d):
    """Every third batch of each run's epoch."""
    history = metric_history(spark, d).select("run", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "step", "loss")
    return logged_batches(numbered_batches(history), 3).select("run", "epoch", "step", "batch_idx", "loss")


@register("best_so_far", """
SELECT user_id AS run, event_id AS step, value AS bleu,
  value > greatest(0.0, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS is_best
FROM events""")
def q_best_so_far(spark, d):
    h = metric_history(spark, d).select("run", "step", "bleu")
    return best_so_far(h, "run", "step", "bleu", block=1 << 10)


@register("final_best", """
SELECT user_id AS run, max(value) AS best, arg_min(event_id, (-value, event_id)) AS best_step FROM events GROUP BY user_id""")
def q_final_best(spark, d):
    return final_best(metric_history(spark, d))


# ---------------------------------------------------------------- 2.6 translation jobs, F5
from tessera.functions.text import ENGLISH  # noqa: E402
from tessera.operators.filters import filter_decisions, quality_filter  # noqa: E402
from tessera.operators.translate import (  # noqa: E402
    DictionaryModel, FunctionModel, back_translation, fit_dictionary_model, round_trip, synthetic_pairs,
)


def _models(pairs: DataFrame) -> tuple[DictionaryModel, DictionaryModel]:
    """(en -> xx, xx -> en) dictionary models fitted on the conversation pairs."""
    en_xx = fit_dictionary_model(pairs, "tgt", "src", TGT_SCRIPT, SRC_SCRIPT, PAIR_KEYS)
    xx_en = fit_dictionary_model(pairs, "src", "tgt", SRC_SCRIPT, TGT_SCRIPT, PAIR_KEYS)
    return en_xx, xx_en


_DICT2 = Q.dict_cte("dict2", "pairs", Q.words_lower("tgt"), Q.marks("src"))
_FWD2 = "fwd2 AS (SELECT src AS tok, tgt AS out FROM dict2)"


@register("synthetic_pairs", f"""
WITH {Q.PAIRS}, {_DICT2}, {_FWD2},
mono AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
{Q.translate_cte('syn', 'text', Q.words_lower, 'fwd2', ' ', rel='mono', keys='doc_id')}
SELECT m.doc_id, m.text AS orig, s.translation AS trans FROM mono m JOIN syn s USING (doc_id)""")
def q_synthetic_pairs(spark, d):
    en_xx, _ = _models(conversation_pairs(spark, d))
    mono = table(spark, d, "documents").where(F.col("lang") == "en").select("doc_id", "text")
    return synthetic_pairs(mono, en_xx, ["doc_id"])


_ROUND_TRIP = f"""{Q.PAIRS}, {Q.DICT}, {Q.FWD}, {_DICT2}, {_FWD2},
mono AS (SELECT doc_id, text FROM documents),
{Q.translate_cte('rt1', 'text', Q.words_lower, 'fwd2', ' ', rel='mono', keys='doc_id')},
{Q.translate_cte('rt2', 'translation', Q.marks, 'fwd', ' ', rel='rt1', keys='doc_id')},
rt AS (SELECT m.doc_id, m.text AS orig, a.translation AS trans, b.translation AS back
       FROM mono m JOIN rt1 a USING (doc_id) JOIN rt2 b USING (doc_id))"""


@register("round_trip", f"""
WITH {_ROUND_TRIP}
SELECT doc_id, orig, trans, back FROM rt""")
def q_round_trip(spark, d):
    en_xx, xx_en = _models(conversation_pairs(spark, d))
    mono = table(spark, d, "documents").select("doc_id", "text")
    return round_trip(mono, en_xx, xx_en, ["doc_id"])


def _reversing_model():
    """A stand-in for a neural model: words in reverse order, the batch as the model would get it."""
    return lambda texts: [" ".join(reversed(t.split())) for t in texts]


@register("function_translation", f"""
WITH t AS (SELECT doc_id, {Q.split_ws("coalesce(text, '')")} AS w FROM documents)
SELECT doc_id, array_to_string(list_reverse(w[1:64])[1:48], ' ') AS translation, len(w) > 64 AS cut FROM t""")
def q_function_translation(spark, d):
    """Any batch function over all documents, texts cut at 64 words and results at 48."""
    model = FunctionModel(_reversing_model, batch_size=16, max_length=64, max_new=48)
    return model.apply(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", "translation").select(
        "doc_id", "translation", (tx.word_count(F.coalesce("text", F.lit(""))) > 64).alias("cut"))


_LATIN = r"'\A[a-zA-Z\s\x0b\p{P}0-9]+\z'"


_BOUNDED = f"""{_ROUND_TRIP},
lat AS MATERIALIZED (SELECT *, coalesce(regexp_matches(orig, {_LATIN}), false) AS latin FROM rt),
tok AS MATERIALIZED (SELECT doc_id, {Q.tok13a('back', True)} AS h, {Q.tok13a('orig', True)} AS r FROM lat WHERE latin),
shared AS (
  SELECT doc_id, sum(least(a.c, b.c)) AS m FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(h) AS w FROM tok) GROUP BY ALL) a
  JOIN (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(r) AS w FROM tok) GROUP BY ALL) b USING (doc_id, w) GROUP BY doc_id),
bound AS MATERIALIZED (
  SELECT doc_id, {Q.bleu_bound_sql('len(h)', 'len(r)', 'least(len(h), len(r))')} AS by_lengths,
         {Q.bleu_bound_sql('len(h)', 'len(r)', 'coalesce(m, 0)')} AS by_shared FROM tok LEFT JOIN shared USING (doc_id)),
qin AS MATERIALIZED (SELECT doc_id, back AS prediction, orig AS reference FROM lat JOIN bound USING (doc_id) WHERE by_shared >= 0.7 - 1e-9),
{Q.bleu_row_stats('qin', 'doc_id', rstrip=True, materialized=True)},
sb AS (SELECT doc_id, {Q.bleu_exp_sql(effective_order=True)} / 100.0 AS bleu FROM (
  SELECT doc_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in BLEU_STAT_COLS)} FROM st)),
decided AS (
  SELECT l.doc_id, l.orig, l.trans, CASE WHEN NOT latin THEN 'ratio' WHEN by_lengths < 0.7 - 1e-9 THEN 'lengths'
           WHEN by_shared < 0.7 - 1e-9 THEN 'shared tokens' ELSE 'n-grams' END AS decided_by,
         CASE WHEN latin THEN coalesce(sb.bleu >= 0.7, false) ELSE length(trans)::DOUBLE / greatest(1, length(orig)) BETWEEN 0.5 AND 2.0 END AS kept
  FROM lat l LEFT JOIN bound USING (doc_id) LEFT JOIN sb USING (doc_id))"""


@register("quality_filter", f"""
WITH {_BOUNDED}
SELECT doc_id, orig, trans FROM decided WHERE kept""")
def q_quality_filter(spark, d):
    return quality_filter(q_round_trip(spark, d), ["doc_id"], threshold=0.7)


@register("filter_decisions", f"""
WITH {_BOUNDED}
SELECT decided_by, count(*) AS n_rows, sum(kept::INT)::BIGINT AS n_kept FROM decided GROUP BY decided_by""")
def q_filter_decisions(spark, d):
    """how many rows each rule decided and kept; what "lengths" and "shared tokens" decide needs no n-grams."""
    return filter_decisions(q_round_trip(spark, d), ["doc_id"], threshold=0.7)


def _refit(name: str, source: str, s_tok: str, t_tok: str) -> str:
    """CTE ``name(tok, out)``: the pairs' alignments followed by the known tokens of ``source(id, pos, tok, out)``, swapped."""
    synthetic = f"""
  UNION ALL SELECT 1, id, 0, pos, out, tok FROM {source} WHERE out IS NOT NULL""" if source else ""
    return f"""{name} AS MATERIALIZED (
  SELECT s AS tok, arg_max(t, (origin, o1, o2, pos)) AS out FROM (
    SELECT 0 AS origin, conv_id AS o1, turn AS o2, pos, s[pos + 1] AS s, t[pos + 1] AS t FROM (
      SELECT conv_id, turn, s, t, unnest(range(0, least(len(s), len(t)))) AS pos FROM (
        SELECT conv_id, turn, {s_tok} AS s, {t_tok} AS t FROM pairs)){synthetic})
  GROUP BY s)"""


def _generated(name: str, lang: str, tokens: str, view: str) -> str:
    """CTE ``name(id, pos, tok, out)``: the tokens of the language's documents with their values."""
    return f"""{name} AS MATERIALIZED (
  SELECT id, pos, x.tok, v.out FROM (
    SELECT doc_id AS id, unnest(s) AS tok, generate_subscripts(s, 1) - 1 AS pos
    FROM (SELECT doc_id, {tokens} AS s FROM documents WHERE lang = '{lang}')) x LEFT JOIN {view} v USING (tok))"""


def _rounds_sql(rounds: int) -> str:
    a, b = Q.words_lower, Q.marks
    ctes = [Q.PAIRS, _refit("ab0", "", a("tgt"), b("src"))]
    parts = []
    for i in range(1, rounds + 1):
        ctes += [_generated(f"sa{i}", "en", a("text"), f"ab{i - 1}"), _refit(f"ba{i}", f"sa{i}", b("src"), a("tgt")),
                 _generated(f"sb{i}", "fr", b("text"), f"ba{i}"), _refit(f"ab{i}", f"sb{i}", a("tgt"), b("src"))]
        for name, lang, direction in ((f"sa{i}", "en", "a-b"), (f"sb{i}", "fr", "b-a")):
            parts.append(f"""SELECT d.doc_id AS id, d.text AS orig, coalesce(t.trans, '') AS trans, {i} AS iteration, '{direction}' AS direction
FROM documents d LEFT JOIN (SELECT id, string_agg(coalesce(out, '[' || tok || ']'), ' ' ORDER BY pos) AS trans FROM {name} GROUP BY id) t
  ON t.id = d.doc_id WHERE d.lang = '{lang}'""")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


@register("back_translation_rounds", _rounds_sql(3))
def q_back_translation_rounds(spark, d):
    pairs = conversation_pairs(spark, d)
    par = pairs.select(F.col("conv_id").alias("o1"), F.col("turn").alias("o2"),
                       F.col("tgt").alias("a_text"), F.col("src").alias("b_text"))
    docs = table(spark, d, "documents")
    mono_a = docs.where(F.col("lang") == "en").select(F.col("doc_id").alias("id"), "text")
    mono_b = docs.where(F.col("lang") == "fr").select(F.col("doc_id").alias("id"), "text")
    return back_translation(spark, par, mono_a, mono_b, ENGLISH, SRC_SCRIPT, rounds=3)


# ---------------------------------------------------------------- A7, A9, A10
from tessera.operators.metrics.edit import corpus_edit_rate  # noqa: E402
from tessera.operators.metrics.meteor import corpus_meteor, with_meteor  # noqa: E402
from tessera.operators.metrics.ter import corpus_ter  # noqa: E402


@register("word_error_rate", f"""
WITH RECURSIVE {Q.HUB}, e AS ({Q.word_edit_rows('hub', _KEYS)}),
s AS (SELECT sum(edits)::BIGINT AS edits, sum(ref_words)::BIGINT AS ref_len, count(*) AS n_rows FROM e)
SELECT round(CASE WHEN ref_len > 0 THEN 100.0::DOUBLE * edits / ref_len WHEN edits > 0 THEN 100.0 ELSE 0.0 END, 6) AS wer, edits, ref_len, n_rows FROM s""")
def q_word_error_rate(spark, d):
    return corpus_edit_rate(scored_examples(spark, d), PAIR_KEYS)


@register("ter_corpus")
def q_ter_corpus(spark, d):
    return corpus_ter(scored_examples(spark, d), PAIR_KEYS)


@register("meteor_corpus")
def q_meteor_corpus(spark, d):
    return corpus_meteor(scored_examples(spark, d), PAIR_KEYS)


@register("meteor_exact", f"""
WITH {Q.HUB}, {Q.meteor_rows('hub', _KEYS)}
SELECT conv_id, turn, round(meteor, 6) AS meteor_exact FROM mrow""")
def q_meteor_exact(spark, d):
    """A7 of every pair, equal words only."""
    return with_meteor(scored_examples(spark, d), PAIR_KEYS).select(*PAIR_KEYS, r6("meteor_exact").alias("meteor_exact"))


_DIR_KEYS = "direction, conv_id, turn"
_REPORT_ROWS = f"""bs AS (WITH {Q.bleu_row_stats('dirs', _DIR_KEYS)} SELECT * FROM st),
ss AS (WITH {Q.bleu_row_stats('dirs', _DIR_KEYS, rstrip=True)} SELECT {_DIR_KEYS}, {', '.join(f'{c} AS s_{c}' for c in BLEU_STAT_COLS)} FROM st),
cs AS (WITH {Q.chrf_stats_sql('dirs', _DIR_KEYS)} SELECT * FROM cst),
ms AS (WITH {Q.meteor_rows('dirs', _DIR_KEYS)} SELECT * FROM mrow),
es AS ({Q.word_edit_rows('dirs', _DIR_KEYS)}),
xs AS (SELECT {_DIR_KEYS}, {Q.bucket_sql('source')} AS bucket, len({Q.split_ws('prediction')}) - len({Q.split_ws('reference')}) AS word_diff,
              CASE WHEN regexp_matches(prediction, '[\\x{{00C0}}-\\x{{00FF}}]') THEN 1 ELSE 0 END AS script FROM dirs),
rs AS (SELECT * FROM xs JOIN bs USING ({_DIR_KEYS}) JOIN ss USING ({_DIR_KEYS}) JOIN cs USING ({_DIR_KEYS}) JOIN ms USING ({_DIR_KEYS}) JOIN es USING ({_DIR_KEYS}))"""
_REPORT_SUMS = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in [*BLEU_STAT_COLS, *[f"s_{c}" for c in BLEU_STAT_COLS], *CHRF_STAT_COLS, "edits", "ref_words",
                                                              "word_diff", "script"])
_REPORT_SCORES = f"""round({Q.bleu_unsmoothed_sql()}, 6) AS bleu, round({Q.bleu_exp_sql(prefix='s_')}, 6) AS bleu_smoothed, round({Q.chrf_sql()}, 6) AS chrf,
  round(meteor, 6) AS meteor_exact, round(CASE WHEN ref_words > 0 THEN 100.0 * edits / ref_words WHEN edits > 0 THEN 100.0 ELSE 0.0 END, 6) AS wer,
  round(word_diff / n_rows, 6) AS avg_length_diff, round(100.0 * script / n_rows, 6) AS untranslated_percentage"""


@register("evaluation_report", f"""
WITH RECURSIVE {Q.DIRS}, {_REPORT_ROWS},
agg AS (SELECT direction, bucket, grouping(direction, bucket) AS g, count(*) AS n_rows, avg(meteor) AS meteor, {_REPORT_SUMS}
        FROM rs GROUP BY GROUPING SETS ((), (direction), (bucket), (direction, bucket)))
SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'direction' WHEN 2 THEN 'bucket' ELSE 'direction, bucket' END AS level, direction, bucket, n_rows,
  {_REPORT_SCORES}
FROM agg""")
def q_evaluation_report(spark, d):
    """A4-A9a, A11-A14 of both directions, by length and overall, from one pass."""
    from tessera.operators.report import evaluation_report

    return evaluation_report(both_direction_examples(spark, d), LO, HI).drop("meteor_exact_stem")


@register("full_report", f"""
WITH RECURSIVE {Q.DIRS}, {_REPORT_ROWS},
agg AS (SELECT bucket, grouping(bucket) AS g, count(*) AS n_rows, avg(meteor) AS meteor, {_REPORT_SUMS}
        FROM rs WHERE direction = 'src-tgt' GROUP BY GROUPING SETS ((), (bucket))),
sc AS (SELECT bucket, g, n_rows, {_REPORT_SCORES} FROM agg),
b AS (SELECT string_agg(bucket || ': ' || (round(bleu * 1000000)::BIGINT) || ' of ' || n_rows, '; ' ORDER BY bucket) AS length_analysis FROM sc WHERE g = 0)
SELECT bleu, bleu_smoothed, meteor_exact, chrf, wer, avg_length_diff, untranslated_percentage, length_analysis FROM sc, b WHERE g = 1""")
def q_full_report(spark, d):
    """A10-A13 in one row; the length table as text (BLEU in millionths)."""
    from tessera.operators.report import full_report

    rep = full_report(scored_examples(spark, d), PAIR_KEYS, LO, HI)
    table_text = F.array_join(F.transform("length_analysis", lambda b: F.concat(
        b["bucket"], F.lit(": "), F.round(b["bleu"] * 1_000_000).cast("long").cast("string"), F.lit(" of "), b["count"].cast("string"))), "; ")
    return rep.select("metrics.bleu", "metrics.bleu_smoothed", "metrics.meteor_exact", "metrics.chrf", "metrics.wer", "error_analysis.*",
                      table_text.alias("length_analysis"))


# ---------------------------------------------------------------- file sources and sinks over derived data
import uuid  # noqa: E402

from tessera.session import shared_folder  # noqa: E402
from tessera.sources.sinks import write_corpus, write_pairs_tsv  # noqa: E402
from tessera.sources.text_files import read_aligned, read_parallel_tsv  # noqa: E402


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tessera-{what}-{uuid.uuid4().hex}"


_ONE_LINE = "regexp_replace(text, '[\\r\\n\\t]', ' ', 'g')"


@register("aligned_files", f"""
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, {Q.strip(_ONE_LINE)} AS en FROM documents WHERE lang = 'en'),
     b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, {Q.strip(_ONE_LINE)} AS fr FROM documents WHERE lang = 'fr')
SELECT line_no, en, fr FROM a JOIN b USING (line_no)""")
def q_aligned_files(spark, d):
    """K1 then S4/N1: one text per line per language, read back and paired by line number."""
    out = _scratch(spark, "corpus")
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", "lang", "text")
    write_corpus(docs, out, order=("doc_id",))
    return read_aligned(spark, f"{out}/lang=en", f"{out}/lang=fr", ("en", "fr"))


_CLEAN_SRC = "regexp_replace(src, '[\\r\\n\\t]', ' ', 'g')"
_CLEAN_TGT = "regexp_replace(tgt, '[\\r\\n\\t]', ' ', 'g')"


@register("parallel_tsv_files", f"""
WITH {Q.PAIRS},
c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, {_CLEAN_SRC} AS s, {_CLEAN_TGT} AS t FROM pairs)
SELECT line_no, {Q.strip('s')} AS src, {Q.strip('t')} AS tgt FROM c
WHERE {Q.strip('s')} <> '' AND {Q.strip('t')} <> ''""")
def q_parallel_tsv_files(spark, d):
    """K6 then S1: pairs written as TSV in (conv_id, turn) order and parsed back."""
    out = _scratch(spark, "tsv")
    write_pairs_tsv(conversation_pairs(spark, d), out, "src", "tgt", order=tuple(PAIR_KEYS))
    return read_parallel_tsv(spark, out)


@register("model_evaluation", f"""
WITH {Q.DIRS}, {Q.bleu_row_stats("(SELECT * FROM dirs WHERE direction = 'src-tgt')", 'conv_id, turn', rstrip=True)},
agg AS ({Q.sum_stats_sql('st')})
SELECT round({Q.bleu_exp_sql()}, 6) AS bleu, n_rows AS count FROM agg""")
def q_model_evaluation(spark, d):
    """Translate the test set with the fitted model and score it (corpus BLEU, 0-100)."""
    from tessera.operators.translate import evaluate

    pairs = conversation_pairs(spark, d)
    _, xx_en = _models(pairs)
    test = pairs.select(*PAIR_KEYS, F.col("src").alias("source"), F.col("tgt").alias("reference"))
    return evaluate(test, xx_en, PAIR_KEYS)


# ---------------------------------------------------------------- files of the translation workflow, written and read back
from tessera.operators.report import bleu_by_length, corpus_scores, direction_report  # noqa: E402
from tessera.operators.translate import generate_translation, load_model, save_model  # noqa: E402
from tessera.sources.sinks import write_dictionary_tsv, write_direction_report, write_report  # noqa: E402
from tessera.sources.text_files import (  # noqa: E402
    read_dictionary, read_monolingual, read_parallel_with_seeds, read_split_table,
)

_DICT_FILE = f"""{Q.PAIRS}, {Q.DICT},
entries AS (SELECT row_number() OVER (ORDER BY first_conv_id, first_turn, first_pos) - 1 AS seq, src, tgt FROM dict)"""


def _dictionary_file(spark, d):
    out = _scratch(spark, "dictionary")
    write_dictionary_tsv(pair_dictionary(conversation_pairs(spark, d)), out)
    return read_dictionary(spark, out)


@register("dictionary_file", f"""
WITH {_DICT_FILE}
SELECT seq, src, tgt FROM entries""")
def q_dictionary_file(spark, d):
    """K2 then S6: the dictionary file keeps its order (O1) as ``seq``."""
    return _dictionary_file(spark, d)


@register("translate_with_file", f"""
WITH {Q.PAIRS}, {Q.DICT}, {Q.FWD}, {Q.translate_cte('tr', 'src', Q.marks, 'fwd', ' ')}
SELECT conv_id, turn, translation FROM tr""")
def q_translate_with_file(spark, d):
    """Induce, write, read, look up."""
    view = forward_view(_dictionary_file(spark, d))
    pairs = conversation_pairs(spark, d)
    return translate(pairs, PAIR_KEYS, "src", view, SRC_SCRIPT, TGT_SCRIPT.joiner).select(*PAIR_KEYS, "translation")


@register("monolingual_file", f"""
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, {Q.strip(_ONE_LINE)} AS text FROM documents WHERE lang = 'fr')
SELECT line_no, 'fr' AS lang, text FROM a WHERE text <> ''""")
def q_monolingual_file(spark, d):
    """S7 over a file of K1."""
    out = _scratch(spark, "mono")
    docs = table(spark, d, "documents").where(F.col("lang") == "fr").select("doc_id", "lang", "text")
    write_corpus(docs, out, order=("doc_id",))
    return read_monolingual(spark, f"{out}/lang=fr", "fr")


_TSV_LINES = f"""{Q.PAIRS},
c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no,
             {Q.strip(f"{_CLEAN_SRC} || chr(9) || {_CLEAN_TGT}")} AS v FROM pairs)"""


@register("evaluation_tsv", f"""
WITH {_TSV_LINES}
SELECT line_no, split_part(v, chr(9), 1) AS src, split_part(v, chr(9), 2) AS tgt FROM c WHERE len(string_split(v, chr(9))) = 2""")
def q_evaluation_tsv(spark, d):
    """K6 then S2: fields are not stripped, only lines."""
    out = _scratch(spark, "tsv")
    write_pairs_tsv(conversation_pairs(spark, d), out, "src", "tgt", order=tuple(PAIR_KEYS))
    return read_parallel_tsv(spark, out, strip_fields=False)


@register("parallel_with_seeds", f"""
WITH {_TSV_LINES}
SELECT line_no, split_part(v, chr(9), 1) AS en, split_part(v, chr(9), 2) AS bo FROM c WHERE len(string_split(v, chr(9))) = 2""")
def q_parallel_with_seeds(spark, d):
    """S3 with its file present."""
    out = _scratch(spark, "parallel")
    write_pairs_tsv(conversation_pairs(spark, d), f"{out}/en-tib.txt", "src", "tgt", order=tuple(PAIR_KEYS))
    return read_parallel_with_seeds(spark, out)


@register("metrics_file", f"""
WITH RECURSIVE {Q.DIRS}, {_REPORT_ROWS},
agg AS (SELECT count(*) AS n_rows, avg(meteor) AS meteor, {_REPORT_SUMS} FROM rs WHERE direction = 'src-tgt'),
sc AS (SELECT {_REPORT_SCORES} FROM agg)
SELECT bleu, meteor_exact, chrf, wer, avg_length_diff, untranslated_percentage FROM sc""")
def q_metrics_file(spark, d):
    """K4: the report's metrics and error analysis (A10), taken in one pass, written as JSON and read back."""
    from tessera.operators.report import full_report

    rep = full_report(scored_examples(spark, d), PAIR_KEYS, LO, HI)
    one = rep.select("metrics.bleu", "metrics.meteor_exact", "metrics.chrf", "metrics.wer", "error_analysis.*")
    out = _scratch(spark, "report")
    write_report(one, out)
    return spark.read.schema(one.schema).json(f"{out}/metrics")


@register("examples_file", f"""
WITH {Q.HUB}
SELECT conv_id, turn, source, reference, prediction FROM hub""")
def q_examples_file(spark, d):
    """K4: the scored examples as JSON lines, read back."""
    hub = scored_examples(spark, d).select(*PAIR_KEYS, "source", "reference", "prediction")
    out = _scratch(spark, "report")
    write_report(corpus_scores(hub), out, hub, keys=tuple(PAIR_KEYS))
    return spark.read.schema(hub.schema).json(f"{out}/translations")


@register("length_report", f"""
WITH {Q.HUB}, {Q.bleu_row_stats('hub', _KEYS)},
b AS (SELECT st.*, CASE WHEN len({Q.split_ws('h.source')}) <= 5 THEN 'short (1-5 words)'
            WHEN len({Q.split_ws('h.source')}) <= 15 THEN 'medium (6-15 words)' ELSE 'long (16+ words)' END AS bucket
      FROM st JOIN hub h USING (conv_id, turn)),
agg AS ({Q.sum_stats_sql('b', 'bucket')})
SELECT bucket, round({Q.bleu_unsmoothed_sql()}, 6) AS bleu, n_rows AS count FROM agg""")
def q_length_report(spark, d):
    """A10's length table, written as JSON (K4) and read back."""
    part = bleu_by_length(scored_examples(spark, d)).select("bucket", "bleu", "count")
    out = _scratch(spark, "report")
    write_direction_report(part, out)
    return spark.read.schema(part.schema).json(out)


@register("direction_files", f"""
WITH {Q.DIRS}, {Q.bleu_row_stats('dirs', 'direction, conv_id, turn', rstrip=True)}, agg AS ({Q.sum_stats_sql('st', 'direction')}),
s AS (SELECT direction, round({Q.bleu_exp_sql()}, 6) AS bleu, n_rows AS count FROM agg),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY conv_id, turn) AS rn FROM dirs) WHERE rn <= 10)
SELECT direction, s.bleu, s.count, x.conv_id, x.turn, x.source, x.reference, x.prediction FROM s JOIN x USING (direction)""")
def q_direction_files(spark, d):
    """K5: one JSON record per direction, read back with a row per example."""
    rep = direction_report(both_direction_examples(spark, d), PAIR_KEYS, 10)
    out = _scratch(spark, "directions")
    write_direction_report(rep, out)
    back = spark.read.schema(rep.schema).json(out)
    return back.select("direction", "bleu", "count", F.explode("examples").alias("x")).select("direction", "bleu", "count", "x.*")


@register("generate_translation", f"""
WITH {Q.PAIRS}, {Q.DICT}, {Q.FWD},
pre AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN {Q.strip(f"regexp_replace(replace(nfc_normalize(text), '.', '. '), '{Q.WS}+', ' ', 'g')")}
       ELSE text END AS t FROM documents),
{Q.translate_cte('tr', 't', Q.marks, 'fwd', ' ', rel='pre', keys='doc_id')}
SELECT doc_id, translation FROM tr""")
def q_generate_translation(spark, d):
    """Script normalisation for one source language, then T1."""
    _, xx_en = _models(conversation_pairs(spark, d))
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return generate_translation(docs, xx_en, ["doc_id"], "text", "lang", "fr", ".").select("doc_id", "translation")


@register("saved_model", f"""
WITH {Q.PAIRS}, {Q.DICT}, {Q.FWD}, {Q.translate_cte('tr', 'src', Q.marks, 'fwd', ' ')}
SELECT conv_id, turn, translation FROM tr""")
def q_saved_model(spark, d):
    """T4: a model saved, loaded and applied (T1); a missing path would give the fallback."""
    pairs = conversation_pairs(spark, d)
    en_xx, xx_en = _models(pairs)
    out = _scratch(spark, "model")
    save_model(xx_en, out)
    model = load_model(spark, out, SRC_SCRIPT, TGT_SCRIPT, fallback=en_xx)
    return model.apply(pairs, PAIR_KEYS, "src", "translation").select(*PAIR_KEYS, "translation")


_PART = "CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END"


@register("split_table", f"""
WITH n AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE doc_id % 10 <> 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id, CASE WHEN rn <= (SELECT floor(n * (1.0::DOUBLE - 0.9::DOUBLE)) FROM n) THEN 'validation' ELSE 'train' END AS split FROM r
UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id % 10 = 0""")
def q_split_table(spark, d):
    """S5 without a validation split: one is cut from train, test stays."""
    out = _scratch(spark, "splits")
    table(spark, d, "documents").select("doc_id", F.expr(_PART).alias("split")).write.parquet(out)
    return read_split_table(spark, out, key="doc_id")


@register("page_cap", _PAGE_SQL + " ORDER BY page_id, pos LIMIT 300")
def q_page_cap(spark, d):
    """L1: the first 300 paragraphs over all pages (the cap is the feature)."""
    return page_paragraphs(table(spark, d, "pages"), LO, HI, max_texts=300)


# ---------------------------------------------------------------- S7: load where complete, else collect
from tessera.sources.corpora import load_or_collect  # noqa: E402


def _collectors(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang") == "en").select("source", "doc_id", "text")
    return {"en": lambda: article_paragraphs(docs, "source", "doc_id", "text", sep="\n", per_topic=100, max_texts=1000),
            "fr": lambda: page_paragraphs(table(spark, d, "pages"), LO, HI, max_texts=1000)}


@register("collected_corpora", f"""
WITH p AS (
  SELECT source, doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT source, doc_id, string_split(text, {Q.NL}) AS parts FROM documents WHERE lang = 'en')),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS rn FROM p
      WHERE len({Q.split_ws('text')}) > 10 AND NOT starts_with(text, '==')),
en AS (SELECT row_number() OVER (ORDER BY source, doc_id, pos) - 1 AS line_no, text FROM f WHERE rn <= 100),
pp AS ({_PAGE_SQL}),
fr AS (SELECT row_number() OVER (ORDER BY page_id, pos) - 1 AS line_no, text FROM pp),
al AS (SELECT 'en' AS lang, line_no, text FROM en WHERE line_no < 1000 UNION ALL SELECT 'fr', line_no, text FROM fr WHERE line_no < 1000)
SELECT lang, line_no, {Q.strip(_ONE_LINE)} AS text FROM al WHERE line_no < 500""")
def q_collected_corpora(spark, d):
    """S7 with no files: articles (S9) and pages (S8) are collected, written (K1) and the first 500 texts a language used (L2)."""
    return load_or_collect(spark, _scratch(spark, "corpora"), _collectors(spark, d), per_lang=500)


@register("loaded_corpora", f"""
WITH a AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line_no, {Q.strip(_ONE_LINE)} AS text
           FROM documents WHERE lang IN ('en', 'fr')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY line_no) AS rn FROM a WHERE text <> '')
SELECT lang, line_no, text FROM b WHERE rn <= 500""")
def q_loaded_corpora(spark, d):
    """S7 with the files of both languages there: they are loaded and nothing is collected."""
    out = _scratch(spark, "corpora")
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", "lang", "text")
    write_corpus(docs, out, order=("doc_id",))
    return load_or_collect(spark, out, _collectors(spark, d), per_lang=500)
