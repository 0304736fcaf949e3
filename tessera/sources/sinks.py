"""Sinks (K1-K6). Ordered outputs use a distributed sort; part files keep the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _one_line(col):
    # A text sink cannot hold line breaks or tabs inside a record.
    return F.regexp_replace(col, "[\\r\\n\\t]", " ")


def write_corpus(df: DataFrame, path: str, fmt: str = "text", lang_col: str = "lang",
                 text_col: str = "text", order: tuple[str, ...] = ("line_no",), replace_all: bool = True) -> None:
    """K1: one folder per language, one text per line, in ``order``. Without ``replace_all`` only the folders of the
    languages written are replaced."""
    out = df.orderBy(lang_col, *order)
    if fmt == "text":
        out = out.select(lang_col, _one_line(F.col(text_col)).alias("value"))
    to = out.write.mode("overwrite").option("partitionOverwriteMode", "static" if replace_all else "dynamic").partitionBy(lang_col)
    to.text(path) if fmt == "text" else to.parquet(path)


def write_dictionary_tsv(dictionary: DataFrame, path: str, order: list[str] | None = None,
                         src: str = "src", tgt: str = "tgt") -> int:
    """K2: ``src<TAB>tgt`` in first-insertion order; returns the entry count."""
    order = order or [c for c in dictionary.columns if c.startswith("first_")]
    dictionary = dictionary.persist()  # written and counted
    ordered = dictionary.orderBy(*order)
    ordered.select(F.concat_ws("\t", _one_line(F.col(src)), _one_line(F.col(tgt))).alias("value")).write.mode("overwrite").text(path)
    n = dictionary.count()
    dictionary.unpersist(blocking=False)
    return n


def write_report(report: DataFrame, path: str, examples: DataFrame | None = None, keys: tuple[str, ...] = ("id",)) -> None:
    """K4: the one-row metrics report as JSON; scored examples as JSON lines in the order of ``keys``."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metrics")
    if examples is not None:
        examples.orderBy(*keys).write.mode("overwrite").json(f"{path}/translations")


def write_direction_report(per_direction: DataFrame, path: str) -> None:
    """K5: one JSON record per direction (BLEU and the first examples)."""
    per_direction.write.mode("overwrite").json(path)


def write_pairs_tsv(df: DataFrame, path: str, a: str, b: str, order: tuple[str, ...] = ("line_no",)) -> None:
    """K6: pairs as TSV."""
    df.orderBy(*order).select(F.concat_ws("\t", _one_line(F.col(a)), _one_line(F.col(b))).alias("value")).write.mode("overwrite").text(path)
