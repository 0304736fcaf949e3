"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark plans: n-gram matches by unnest + GROUP BY,
ranks by ``row_number``; regular expressions in RE2. Python's whitespace set in
RE2 is ``[\\s\\x0b\\p{Z}\\x1c-\\x1f\\x{85}]``.
"""

from __future__ import annotations

import re

WS = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]"
NL = "chr(10)"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def marks(x: str) -> str:
    # stand-in syllable marks: space, full stop, newline
    return f"list_filter(regexp_split_to_array({x}, '[ .\\n]'), lambda t: t <> '')"


def words_lower(x: str) -> str:
    return split_ws(f"lower({x})")


def tok13a(x: str, rstrip: bool = False) -> str:
    if rstrip:
        x = f"regexp_replace({x}, '{WS}+$', '', 'g')"
    y = f"replace(replace(replace({x}, '<skipped>', ''), '-' || {NL}, ''), {NL}, ' ')"
    y = f"replace(replace(replace(replace({y}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    y = f"(' ' || {y} || ' ')"
    y = f"regexp_replace({y}, '([\\{{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])', ' \\1 ', 'g')"
    y = f"regexp_replace({y}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    y = f"regexp_replace({y}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    y = f"regexp_replace({y}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return split_ws(y)


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

def dict_cte(name: str, rel: str, s_tok: str, t_tok: str, order: str = "conv_id, turn") -> str:
    """CTE ``name(src, tgt, first_<order>..., first_pos)``: last write wins per source token."""
    cols = [c.strip() for c in order.split(",")]
    firsts = ",\n         ".join(f"arg_min({c}, ({order}, pos)) AS first_{c}" for c in [*cols, "pos"])
    return f"""{name}_al AS (
  SELECT {order}, pos, s[pos + 1] AS src, t[pos + 1] AS tgt FROM (
    SELECT {order}, s, t, unnest(range(0, least(len(s), len(t)))) AS pos FROM (
      SELECT {order}, {s_tok} AS s, {t_tok} AS t FROM {rel}))),
{name} AS (
  SELECT src, arg_max(tgt, ({order}, pos)) AS tgt,
         {firsts}
  FROM {name}_al GROUP BY src)"""


DICT = dict_cte("dict", "pairs", marks("src"), words_lower("tgt"))

REV = """rev AS (
  SELECT tgt AS tok, arg_max(src, (first_conv_id, first_turn, first_pos)) AS out FROM dict GROUP BY tgt)"""


def translate_cte(name: str, text: str, tokens_fn, view: str, joiner: str, rel: str = "pairs",
                  keys: str = "conv_id, turn") -> str:
    """CTE ``name(keys..., translation)`` over ``rel``."""
    return f"""{name}_t AS (
  SELECT {keys}, unnest(s) AS tok, generate_subscripts(s, 1) AS pos FROM (
    SELECT {keys}, {tokens_fn(text)} AS s FROM {rel})),
{name}_j AS (
  SELECT {keys}, string_agg(coalesce(v.out, '[' || x.tok || ']'), '{joiner}' ORDER BY x.pos) AS translation
  FROM {name}_t x LEFT JOIN (SELECT tok, out FROM {view} WHERE out IS NOT NULL AND out <> '') v USING (tok)
  GROUP BY {keys}),
{name} AS (
  SELECT {", ".join("p." + k.strip() for k in keys.split(","))}, coalesce(j.translation, '') AS translation
  FROM {rel} p LEFT JOIN {name}_j j USING ({keys}))"""


FWD = "fwd AS (SELECT src AS tok, tgt AS out FROM dict)"

HUB = ",\n".join([
    PAIRS, DICT, FWD, translate_cte("tr", "src", marks, "fwd", " "),
    """hub AS (SELECT p.conv_id, p.turn, p.src AS source, p.tgt AS reference, tr.translation AS prediction
  FROM pairs p JOIN tr USING (conv_id, turn))""",
])

DIRS = ",\n".join([
    PAIRS, DICT, FWD, REV,
    translate_cte("trf", "src", marks, "fwd", " "),
    translate_cte("trr", "tgt", words_lower, "rev", " "),
    """dirs AS (
  SELECT 'src-tgt' AS direction, p.conv_id, p.turn, p.src AS source, p.tgt AS reference, f.translation AS prediction
  FROM pairs p JOIN trf f USING (conv_id, turn)
  UNION ALL
  SELECT 'tgt-src' AS direction, p.conv_id, p.turn, p.tgt AS source, p.src AS reference, r.translation AS prediction
  FROM pairs p JOIN trr r USING (conv_id, turn))""",
])


def bleu_row_stats(src_rel: str, keys: str, rstrip: bool = False, materialized: bool = False) -> str:
    """CTE ``st(keys..., match_1..4, total_1..4, hyp_len, ref_len)`` from (keys, prediction, reference)."""
    m = "MATERIALIZED " if materialized else ""
    return f"""tk AS {m}(SELECT {keys}, {tok13a('prediction', rstrip)} AS h, {tok13a('reference', rstrip)} AS r FROM {src_rel}),
hg AS {m}(SELECT {keys}, n, g, count(*) AS c FROM (
  SELECT {keys}, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g
  FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
rg AS {m}(SELECT {keys}, n, g, count(*) AS c FROM (
  SELECT {keys}, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g
  FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
mt AS {m}(SELECT {keys}, n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg USING ({keys}, n, g) GROUP BY ALL),
st AS (SELECT {', '.join('tk.' + k.strip() for k in keys.split(','))},
  coalesce(sum(CASE WHEN mt.n = 1 THEN mt.m END), 0) AS match_1,
  coalesce(sum(CASE WHEN mt.n = 2 THEN mt.m END), 0) AS match_2,
  coalesce(sum(CASE WHEN mt.n = 3 THEN mt.m END), 0) AS match_3,
  coalesce(sum(CASE WHEN mt.n = 4 THEN mt.m END), 0) AS match_4,
  greatest(len(any_value(tk.h)) - 0, 0) AS total_1,
  greatest(len(any_value(tk.h)) - 1, 0) AS total_2,
  greatest(len(any_value(tk.h)) - 2, 0) AS total_3,
  greatest(len(any_value(tk.h)) - 3, 0) AS total_4,
  len(any_value(tk.h)) AS hyp_len, len(any_value(tk.r)) AS ref_len
  FROM tk LEFT JOIN mt USING ({keys}) GROUP BY {', '.join('tk.' + k.strip() for k in keys.split(','))})"""


def sum_stats_sql(rel: str, by: str | None = None) -> str:
    cols = [f"match_{n}" for n in range(1, 5)] + [f"total_{n}" for n in range(1, 5)] + ["hyp_len", "ref_len"]
    sel = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in cols)
    if by:
        return f"SELECT {by}, {sel}, count(*) AS n_rows FROM {rel} GROUP BY {by}"
    return f"SELECT {sel}, count(*) AS n_rows FROM {rel}"


def bleu_unsmoothed_sql() -> str:
    allpos = " AND ".join(f"total_{n} > 0 AND match_{n} > 0" for n in range(1, 5))
    logs = " + ".join(f"ln(match_{n} / total_{n})" for n in range(1, 5))
    bp = "CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1.0 - ref_len / hyp_len) END"
    return f"(CASE WHEN {allpos} THEN exp(({logs}) / 4.0) ELSE 0.0 END) * ({bp})"


def bleu_exp_sql(effective_order: bool = False, prefix: str = "") -> str:
    sql = _bleu_exp_sql(effective_order)
    return re.sub(r"\b(match_\d|total_\d|hyp_len|ref_len)\b", prefix + r"\1", sql) if prefix else sql


def _bleu_exp_sql(effective_order: bool) -> str:
    bp = "CASE WHEN hyp_len < ref_len THEN (CASE WHEN hyp_len > 0 THEN exp(1.0 - ref_len / hyp_len) ELSE 0.0 END) ELSE 1.0 END"
    terms = []
    zeros = []
    for n in range(1, 5):
        zeros.append(f"(CASE WHEN match_{n} = 0 THEN 1 ELSE 0 END)")
        z = " + ".join(zeros)
        p = f"(CASE WHEN match_{n} > 0 THEN 100.0 * match_{n} / total_{n} ELSE 100.0 / (pow(2.0, {z}) * total_{n}) END)"
        terms.append(f"(CASE WHEN total_{n} > 0 THEN ln({p}) ELSE 0.0 END)")
    logs = " + ".join(terms)
    any_match = "(match_1 + match_2 + match_3 + match_4) > 0"
    if effective_order:
        eff = " + ".join(f"(CASE WHEN total_{n} > 0 THEN 1 ELSE 0 END)" for n in range(1, 5))
        return f"(CASE WHEN {any_match} AND ({eff}) > 0 THEN ({bp}) * exp(({logs}) / ({eff})) ELSE 0.0 END)"
    return f"(CASE WHEN {any_match} AND total_4 > 0 THEN ({bp}) * exp(({logs}) / 4.0) ELSE 0.0 END)"


def chrf_stats_sql(src_rel: str, keys: str) -> str:
    """CTE ``cst(keys..., chyp_n, cref_n, cmatch_n)``."""
    ws = f"'{WS}+'"
    return f"""ck AS (SELECT {keys}, regexp_replace(prediction, {ws}, '', 'g') AS h, regexp_replace(reference, {ws}, '', 'g') AS r FROM {src_rel}),
chg AS (SELECT {keys}, n, g, count(*) AS c FROM (
  SELECT {keys}, n, unnest(list_transform(range(1, length(h) - n + 2), lambda i: substring(h, i, n))) AS g
  FROM ck, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n)) GROUP BY ALL),
crg AS (SELECT {keys}, n, g, count(*) AS c FROM (
  SELECT {keys}, n, unnest(list_transform(range(1, length(r) - n + 2), lambda i: substring(r, i, n))) AS g
  FROM ck, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n)) GROUP BY ALL),
cmt AS (SELECT {keys}, n, sum(least(chg.c, crg.c)) AS m FROM chg JOIN crg USING ({keys}, n, g) GROUP BY ALL),
cst AS (SELECT {', '.join('ck.' + k.strip() for k in keys.split(','))},
  {', '.join(f"CASE WHEN length(any_value(ck.r)) >= {n} THEN greatest(length(any_value(ck.h)) - {n - 1}, 0) ELSE 0 END AS chyp_{n}, greatest(length(any_value(ck.r)) - {n - 1}, 0) AS cref_{n}, coalesce(sum(CASE WHEN cmt.n = {n} THEN cmt.m END), 0) AS cmatch_{n}" for n in range(1, 7))}
  FROM ck LEFT JOIN cmt USING ({keys}) GROUP BY {', '.join('ck.' + k.strip() for k in keys.split(','))})"""


def chrf_sql() -> str:
    sp = " + ".join(f"(CASE WHEN chyp_{n} > 0 THEN cmatch_{n} / chyp_{n} ELSE 1e-16 END)" for n in range(1, 7))
    sr = " + ".join(f"(CASE WHEN cref_{n} > 0 THEN cmatch_{n} / cref_{n} ELSE 1e-16 END)" for n in range(1, 7))
    eff = " + ".join(f"(CASE WHEN chyp_{n} > 0 AND cref_{n} > 0 THEN 1 ELSE 0 END)" for n in range(1, 7))
    ap = f"(CASE WHEN ({eff}) > 0 THEN ({sp}) / ({eff}) ELSE 0.0 END)"
    ar = f"(CASE WHEN ({eff}) > 0 THEN ({sr}) / ({eff}) ELSE 0.0 END)"
    return f"(CASE WHEN {ap} + {ar} > 0 THEN 100.0 * 5.0 * {ap} * {ar} / (4.0 * {ap} + {ar}) ELSE 0.0 END)"


def sum_chrf_sql(rel: str) -> str:
    cols = [f"{k}_{n}" for n in range(1, 7) for k in ("chyp", "cref", "cmatch")]
    return "SELECT " + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in cols) + f", count(*) AS n_rows FROM {rel}"


def bucket_sql(x: str) -> str:
    n = f"len({split_ws(x)})"
    return f"CASE WHEN {n} <= 5 THEN 'short (1-5 words)' WHEN {n} <= 15 THEN 'medium (6-15 words)' ELSE 'long (16+ words)' END"


def meteor_rows(src_rel: str, keys: str) -> str:
    """CTE ``mrow(keys..., meteor)``: equal words only; the k-th last occurrence on one side meets the k-th last on the other."""
    side = "\n".join(f"""m{x} AS (SELECT *, row_number() OVER (PARTITION BY {keys}, w ORDER BY pos DESC) AS k FROM (
  SELECT {keys}, unnest({x}) AS w, generate_subscripts({x}, 1) AS pos FROM mtok)),""" for x in ("h", "r"))
    tk = ", ".join("t." + k.strip() for k in keys.split(","))
    return f"""mtok AS (SELECT {keys}, {words_lower('prediction')} AS h, {words_lower('reference')} AS r FROM {src_rel}),
{side}
mm AS (SELECT {keys}, mh.pos AS i, mr.pos AS j FROM mh JOIN mr USING ({keys}, w, k)),
mc AS (SELECT {keys}, count(*)::DOUBLE AS m, sum(CASE WHEN i - li = 1 AND j - lj = 1 THEN 0 ELSE 1 END)::DOUBLE AS c FROM (
  SELECT *, lag(i) OVER (PARTITION BY {keys} ORDER BY i) AS li, lag(j) OVER (PARTITION BY {keys} ORDER BY i) AS lj FROM mm) GROUP BY {keys}),
mrow AS (SELECT {tk}, CASE WHEN m IS NULL THEN 0.0 ELSE (1.0 - 0.5 * pow(c / m, 3.0)) * (m / len(h)) * (m / len(r)) / (0.9 * (m / len(h)) + 0.1 * (m / len(r))) END AS meteor
  FROM mtok t LEFT JOIN mc USING ({keys}))"""


def word_edit_rows(src_rel: str, keys: str) -> str:
    """Query of ``keys..., edits, ref_words``: the word edit distance of every row, one table row of the programme per step."""
    wk = ", ".join("w." + k.strip() for k in keys.split(","))
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS id, {keys}, {words_lower('prediction')} AS h, {words_lower('reference')} AS r FROM {src_rel}),
dp AS (
  SELECT id, 0 AS i, range(0, len(r) + 1) AS prev FROM w
  UNION ALL
  SELECT dp.id, dp.i + 1,
    list_reduce(list_prepend([dp.i + 1], list_transform(range(1, len(w.r) + 1), lambda j:
        [least(dp.prev[j + 1] + 1, dp.prev[j] + CASE WHEN w.h[dp.i + 1] = w.r[j] THEN 0 ELSE 1 END)])),
      lambda acc, x: list_append(acc, least(x[1], acc[len(acc)] + 1)))
  FROM dp JOIN w USING (id) WHERE dp.i < len(w.h)
)
SELECT {wk}, len(w.r) AS ref_words, dp.prev[len(w.r) + 1] AS edits FROM dp JOIN w ON w.id = dp.id AND dp.i = len(w.h)"""


def bleu_bound_sql(h: str, r: str, m: str) -> str:
    """An upper bound of the sentence BLEU (0-1) from two lengths and the number of shared tokens."""
    logs = " + ".join(f"(CASE WHEN {h} >= {n} THEN ln(greatest(least({m}, {h} - {n - 1}, {r} - {n - 1}), 0.5) / ({h} - {n - 1})) ELSE 0 END)" for n in range(1, 5))
    return f"(CASE WHEN {h} = 0 OR {m} = 0 THEN 0.0 ELSE exp(least(0, 1 - {r}::DOUBLE / {h}) + ({logs}) / least({h}, 4)) END)"
