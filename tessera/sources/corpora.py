"""Monolingual corpora: loaded where all their files are there, else collected and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.split import first_per_group
from tessera.sources.sinks import write_corpus
from tessera.sources.text_files import is_missing, read_monolingual


def corpus_path(folder: str, lang: str) -> str:
    return f"{folder.rstrip('/')}/lang={lang}"


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether there are text files at ``path``."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return False


def load_or_collect(spark: SparkSession, folder: str, collect: dict[str, Callable[[], DataFrame]], per_lang: int | None = None) -> DataFrame:
    """``lang, line_no, text`` of the languages of ``collect``.

    If every language has its files under ``folder``, they are loaded. If any is missing, all languages are collected
    anew: ``collect[lang]()`` gives ``(order..., text)``, the texts are written one per line in the order of the other
    columns, and read back, so that this run and a later one that loads them use the same rows.
    ``per_lang`` keeps the first texts of each language (L2).
    """
    if not all(is_there(spark, corpus_path(folder, lang)) for lang in collect):
        for lang, rows in collect.items():
            found = rows()
            write_corpus(found.withColumn("lang", F.lit(lang)), folder, order=tuple(c for c in found.columns if c != "text"), replace_all=False)
    every = None
    for lang in collect:
        part = read_monolingual(spark, corpus_path(folder, lang), lang) if is_there(spark, corpus_path(folder, lang)) else spark.createDataFrame(
            [], "line_no long, lang string, text string")  # nothing was found
        every = part if every is None else every.unionByName(part)
    every = every.select("lang", "line_no", "text")
    return every if per_lang is None else first_per_group(every, ["lang"], ["line_no"], per_lang)
