"""Line sources: TSV pairs, line-aligned files, dictionaries, monolingual corpora.

Line numbers (N1) are computed without a single-partition window: each file split
keeps its rows contiguous inside one scan partition, so a row's number is the
number of lines in earlier splits (a table with one row per split) plus its
offset inside the split (from ``monotonically_increasing_id``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from tessera.functions.text import py_strip
from tessera.sources.samples import SEED_PAIRS


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because its path does not exist; every other failure is raised on."""
    return error.getCondition() == "PATH_NOT_FOUND"


def with_line_numbers(raw: DataFrame) -> DataFrame:
    """N1 over a ``spark.read.text`` frame: adds ``line_no`` (0-based, over files in path order)."""
    tagged = raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    # Lines per split, then the splits' offsets inside their file, then the files' offsets: windows
    # over one file's splits and over one row per file. Part files sort by the numbers in their name.
    splits = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in"))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n")).withColumn("_order", file_order(F.col("_file")))
    before = Window.orderBy("_order", "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = within.join(files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "_file")
    return (
        tagged.join(offsets, ["_file", "_block"])
        .select((F.col("_off") + F.col("_in") + F.col("_mid") - F.col("_first")).alias("line_no"), "value")
    )


def file_order(path: Column) -> Column:
    """Sort key of a path: every run of digits in its last part is padded, so part-99999 comes before part-100000."""
    name = F.element_at(F.split(path, "/"), -1)
    number = F.lpad(F.regexp_extract(name, "^part-(\\d+)", 1), 20, "0")
    return F.concat(number, F.lit("|"), path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with ``line_no``; blank lines kept (alignment depends on them)."""
    return with_line_numbers(spark.read.text(path))


def parse_pairs(lines: DataFrame, names=("src", "tgt"), strip_fields: bool = True) -> DataFrame:
    """S1/S2 over ``(line_no, value)``: skip blank lines, strip, split on tab, keep arity 2."""
    s = py_strip(F.col("value"))
    parts = F.split(s, "\t", -1)
    out = lines.where((F.length(s) > 0) & (F.size(parts) == 2))  # F1, F2
    a, b = parts.getItem(0), parts.getItem(1)
    if strip_fields:
        a, b = py_strip(a), py_strip(b)
    return out.select("line_no", a.alias(names[0]), b.alias(names[1]))


def read_parallel_tsv(spark: SparkSession, path: str, names=("src", "tgt"), strip_fields: bool = True) -> DataFrame:
    """S1 (fields stripped) / S2 (``strip_fields=False``). Not ``read.csv``: quotes stay literal."""
    return parse_pairs(read_lines(spark, path), names, strip_fields)


def read_parallel_with_seeds(spark: SparkSession, data_dir: str, names=("en", "bo")) -> DataFrame:
    """S3: ``<dir>/en-tib.txt`` if it has any well-formed pair, else the two seed pairs."""
    seeds = spark.createDataFrame(
        [(i, en, bo) for i, (en, bo) in enumerate(SEED_PAIRS)], f"line_no long, {names[0]} string, {names[1]} string"
    )
    try:
        pairs = read_parallel_tsv(spark, f"{data_dir}/en-tib.txt", names, strip_fields=False)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return seeds
    return seeds if pairs.isEmpty() else pairs


def read_aligned(spark: SparkSession, path_a: str, path_b: str, names=("bo", "en"), strict: bool = False) -> DataFrame:
    """Two line-aligned files, each line stripped, blank lines kept, paired by line number.

    A longer file is cut to the shorter one (inner join); ``strict`` raises instead.
    """
    a = read_lines(spark, path_a).select("line_no", py_strip(F.col("value")).alias(names[0]))
    b = read_lines(spark, path_b).select("line_no", py_strip(F.col("value")).alias(names[1]))
    if strict:
        na, nb = a.count(), b.count()
        if na != nb:
            raise ValueError(f"line counts differ: {na} vs {nb}")
    return a.join(b, "line_no", "inner")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, src, tgt)`` in file order; a missing file gives an empty dictionary."""
    try:
        return read_parallel_tsv(spark, path, ("src", "tgt"), strip_fields=False).withColumnRenamed("line_no", "seq")
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([], "seq long, src string, tgt string")


def read_monolingual(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Stripped, non-blank lines with ``line_no`` and ``lang``."""
    s = py_strip(F.col("value"))
    return read_lines(spark, path).where(F.length(s) > 0).select("line_no", F.lit(lang).alias("lang"), s.alias("text"))


def read_split_table(spark: SparkSession, path: str, key: str = "line_no", seed: int = 42, ratio: float = 0.9) -> DataFrame:
    """A table ``(split, ...)``; without a ``validation`` split, one is cut from ``train``.

    ``key`` must tell the train rows apart. Other splits stay as they are.
    """
    from tessera.operators.split import exact_split, val_first_size

    df = spark.read.parquet(path)
    if not df.where(F.col("split") == "validation").isEmpty():
        return df
    cut = exact_split(df.where(F.col("split") == "train").drop("split"), key, seed, val_first_size(ratio), ("validation", "train"))
    return cut.select(*df.columns).unionByName(df.where(~F.col("split").eqNullSafe("train")))


def sample_pairs(spark: SparkSession) -> DataFrame:
    """The ten inline sample pairs ``(line_no, bo, en)``."""
    from tessera.sources.samples import SAMPLE_PAIRS

    return spark.createDataFrame([(i, bo, en) for i, (bo, en) in enumerate(SAMPLE_PAIRS)], "line_no long, bo string, en string")

