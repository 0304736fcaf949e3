"""Paragraph extraction over fetched pages and articles.

The reference fetches pages over HTTP and parses them with an HTML parser; here
the pages are a table and paragraphs are cut by a fixed regular-expression rule
(no lookarounds, so Java and RE2 read it alike):

1. drop comments, scripts and styles;
2. mark paragraph starts ``<p ...>`` and ends ``</p>``, ``</article>``, ``</body>``;
3. keep the pieces that follow a start mark;
4. drop tags, decode character references, collapse ASCII whitespace, trim.

This rule ends a paragraph at the next start or end mark. ``parsed_paragraphs`` nests paragraphs as a parser
without implied end tags does: an unclosed ``<p>`` goes on until an element around it ends, and holds the
text of the paragraphs inside it.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions.text import contains_script, py_split, py_strip

DROP_BLOCKS = "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
P_START = "(?i)<p(\\s[^>]*)?>"
P_END = "(?i)</p>|</article>|</body>"
TAG = "<[^>]*>"


@F.pandas_udf(T.StringType())
def _references(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def _decode(x: Column) -> Column:
    """Character references as signs: decimal, hexadecimal and the standard named ones. A no-break space given as
    ``&nbsp;`` counts as a space. Texts without ``&`` stay in the JVM."""
    x = F.replace(x, F.lit("&nbsp;"), F.lit(" "))
    return F.when(F.contains(x, F.lit("&")), _references(F.when(F.contains(x, F.lit("&")), x))).otherwise(x)


def page_paragraphs(pages: DataFrame, lo: int = 0x0F00, hi: int = 0x0FFF, max_texts: int | None = None,
                    id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, pos, text)`` paragraphs holding a code point in [lo, hi], in source order,
    capped at ``max_texts`` (L1) when given."""
    x = F.regexp_replace(F.col(html_col), DROP_BLOCKS, " ")
    x = F.regexp_replace(x, P_START, "\u0001P")
    x = F.regexp_replace(x, P_END, "\u0001X")
    pieces = pages.select(id_col, F.posexplode(F.split(x, "\u0001")).alias("pos", "piece"))
    body = F.substring(F.col("piece"), 2, 1 << 30)
    text = F.regexp_replace(body, TAG, " ")
    text = _decode(text)
    text = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))
    paras = (
        pieces.where(F.col("piece").startswith("P"))
        .select(id_col, F.col("pos").cast("long").alias("pos"), text.alias("text"))
        .where((F.length("text") > 0) & contains_script(F.col("text"), lo, hi))  # F4
    )
    if max_texts is None:
        return paras
    return paras.orderBy(id_col, "pos").limit(max_texts)  # L1: the cap is the feature


# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKUP = "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[!?][^>]*>"
ELEMENT = "</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
CUT = "\u0001"


def paragraph_spans(tags: list[str], name: str = "p") -> list[tuple[int, int]]:
    """For each ``<name>`` in order, the first and last text piece that it holds; piece i stands before tag i.

    An end tag closes the nearest open element of its name and all that were opened inside it; without one it says nothing.
    """
    stack, opened, spans = [], {}, []
    for i, tag in enumerate(tags):
        what = tag.strip("</>").split(None, 1)[0].split("/", 1)[0].lower()
        if not tag.startswith("</"):
            if what in VOID:
                continue
            if what == name:
                spans.append((i + 1, i if tag.endswith("/>") else len(tags)))
            if not tag.endswith("/>"):
                stack.append((what, len(spans) - 1))
                opened[what] = opened.get(what, 0) + 1
        elif opened.get(what):
            while True:
                top, at = stack.pop()
                opened[top] -= 1
                if top == name:
                    spans[at] = (spans[at][0], i)
                if top == what:
                    break
    return spans


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paragraphs(tags: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for t, pieces in zip(tags, texts):
        pieces = [html.unescape(x) if "&" in x else x for x in (() if pieces is None else pieces)]
        out.append(["".join(pieces[a:b + 1]) for a, b in paragraph_spans([] if t is None else list(t))])
    return pd.Series(out, dtype=object)


def parsed_paragraphs(pages: DataFrame, lo: int = 0x0F00, hi: int = 0x0FFF, max_texts: int | None = None,
                      id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S8 as a parser nests it: ``(page_id, pos, text)`` of every ``<p>`` in source order (``pos`` counts all of a page from 0)
    whose stripped text holds a code point in [lo, hi]; capped at ``max_texts`` (L1) when given.

    The text of an element is all text inside it, without separators. Tags and texts are cut by Spark; the nesting of
    a page is one pass over its tags. Null pages have no paragraphs.
    """
    from tessera.plans.physical import spread
    from tessera.session import ship_package

    ship_package(pages.sparkSession)
    clean = F.replace(F.regexp_replace(F.col(html_col), MARKUP, ""), F.lit(CUT), F.lit(""))
    cut = spread(pages.select(id_col, html_col)).select(
        id_col, F.regexp_extract_all(clean, F.lit(ELEMENT), F.lit(0)).alias("tags"), F.split(F.regexp_replace(clean, ELEMENT, CUT), CUT, -1).alias("texts"))
    paras = cut.select(id_col, _paragraphs.asNondeterministic()("tags", "texts").alias("p")).select(id_col, F.posexplode("p").alias("pos", "text"))
    paras = paras.select(id_col, F.col("pos").cast("long").alias("pos"), py_strip(F.col("text")).alias("text")).where(contains_script(F.col("text"), lo, hi))  # F4
    return paras if max_texts is None else paras.orderBy(id_col, "pos").limit(max_texts)  # L1: the cap is the feature


def article_paragraphs(articles: DataFrame, topic_col: str = "source", order_col: str = "doc_id",
                       text_col: str = "text", sep: str = "\n\n", per_topic: int | None = None,
                       max_texts: int | None = None, min_words: int = 10) -> DataFrame:
    """Split articles on ``sep``; keep paragraphs with more than ``min_words`` words
    not starting with ``==`` (F3); first ``per_topic`` per topic (W1); global cap (L1).

    W1 is a ``row_number() <= k`` filter, which Spark plans with a partial
    WindowGroupLimit before the shuffle: a hot topic ships at most k rows per task.
    """
    paras = articles.select(topic_col, order_col, F.posexplode(F.split(F.col(text_col), sep, -1)).alias("pos", "text"))
    paras = paras.withColumn("pos", F.col("pos").cast("long"))
    paras = paras.where((F.size(py_split(F.col("text"))) > min_words) & ~F.col("text").startswith("=="))
    w = Window.partitionBy(topic_col).orderBy(order_col, "pos")
    kept = paras if per_topic is None else paras.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_topic).drop("_rn")
    if max_texts is None:
        return kept
    return kept.orderBy(topic_col, order_col, "pos").limit(max_texts)
