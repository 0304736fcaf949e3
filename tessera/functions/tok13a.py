"""The "13a" BLEU tokeniser (mteval-v13a rules as published with sacreBLEU), as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import py_rstrip, py_split

# The 13a rules, applied in this order.
RULE_SYMBOLS = ("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " $1 ")
RULE_PERIOD_COMMA_AFTER_NONDIGIT = ("([^0-9])([\\.,])", "$1 $2 ")
RULE_PERIOD_COMMA_BEFORE_NONDIGIT = ("([\\.,])([^0-9])", " $1 $2")
RULE_DASH_AFTER_DIGIT = ("([0-9])(-)", "$1 $2 ")
ENTITY_DECODES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokenize_13a(col: Column, rstrip: bool = False) -> Column:
    """Array of 13a tokens. ``rstrip`` mirrors sacreBLEU's trailing-whitespace strip."""
    x = py_rstrip(col) if rstrip else col
    x = F.replace(x, F.lit("<skipped>"), F.lit(""))
    x = F.replace(x, F.lit("-\n"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    for ent, ch in ENTITY_DECODES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pat, rep in (RULE_SYMBOLS, RULE_PERIOD_COMMA_AFTER_NONDIGIT, RULE_PERIOD_COMMA_BEFORE_NONDIGIT, RULE_DASH_AFTER_DIGIT):
        x = F.regexp_replace(x, pat, rep)
    return py_split(x)
