"""Translation edit rate with block shifts (A9b), as rows and joins.

After Snover et al. (2006): words may be moved in blocks at a cost of one edit, and the rate counts the
shifts and the word edits that are left, over the reference words. Shifts are taken greedily: in each round every
pair makes the shift after which its edit distance is least, as long as that lowers it.

[pin] what may be shifted is a longest run of words that stands in the reference at another place, at most
``max_dist`` words away. It is moved to the place that the reference names: its own index there, behind the
word before it, or in front of the word after it (the first such word from ``index - length`` on).

A pair's words are code points of one string each. A round explodes the words to rows, finds equal words by an equi-join
on (pair, word, stretch of ``max_dist`` words), runs by their diagonals, moves them, measures all candidates
with Spark's ``levenshtein`` and keeps the best of each pair; its result is written. Pairs that no shift improves
leave, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.text import words_lower
from tessera.operators.metrics.edit import rate
from tessera.operators.metrics.rows import coded_words
from tessera.plans.physical import cut_lineage

MAX_DIST = 50  # words a block may move, as in the published tool


def _places(pairs: DataFrame, side: str, place: str) -> DataFrame:
    """``_row, <place>, w`` for every word of a side."""
    return pairs.select("_row", F.posexplode(F.regexp_extract_all(side, F.lit("(?s)."), F.lit(0))).alias(place, "w"))


def equal_runs(pairs: DataFrame, max_dist: int = MAX_DIST) -> DataFrame:
    """``_row, i, j, l``: the longest runs of l words that stand at i in ``h`` and at another place j, at most ``max_dist`` away, in ``r``."""
    h = _places(pairs, "h", "i").withColumn("b", F.floor(F.col("i") / max_dist))
    r = _places(pairs, "r", "j").withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("j") / max_dist) + k)))
    # exploded rows are many more than their plan's estimate: never broadcast
    met = h.join(r.hint("shuffle_merge"), ["_row", "w", "b"]).where((F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= max_dist)).select(
        "_row", "i", (F.col("j") - F.col("i")).alias("diagonal"))
    along = Window.partitionBy("_row", "diagonal").orderBy("i")
    runs = met.withColumn("run", F.col("i") - F.row_number().over(along)).groupBy("_row", "diagonal", "run").agg(
        F.min("i").alias("i"), F.count(F.lit(1)).cast("int").alias("l"))
    return runs.select("_row", "i", (F.col("i") + F.col("diagonal")).alias("j"), "l")


def best_shifts(pairs: DataFrame, max_dist: int = MAX_DIST) -> DataFrame:
    """The pairs (``_row, h, r, d, shifts``) that a shift improves, after the best one: the least distance, then the longest block, the first
    place it comes from and the first it goes to."""
    moved = equal_runs(pairs, max_dist).join(pairs.hint("shuffle_merge"), "_row").withColumn("rest", F.expr("concat(left(h, i), substring(h, i + l + 1))")).withColumn(
        "to", F.explode(F.array_distinct(F.array(
            F.expr("least(j, length(rest))"),
            F.expr("CASE WHEN j = 0 THEN 0 ELSE nullif(locate(substring(r, j, 1), rest, greatest(1, j - l)), 0) END"),
            F.expr("CASE WHEN j + l = length(r) THEN length(rest) ELSE nullif(locate(substring(r, j + l + 1, 1), rest, greatest(1, j - l + 1)), 0) - 1 END")))))
    moved = moved.where(F.col("to").isNotNull() & (F.col("to") != F.col("i")) & (F.abs(F.col("to") - F.col("i")) <= max_dist))
    tried = moved.withColumn("new", F.expr("concat(left(rest, to), substring(h, i + 1, l), substring(rest, to + 1))")).withColumn("e", F.levenshtein("new", "r"))
    better = tried.where("e < d").groupBy("_row").agg(F.min(F.struct("e", (-F.col("l")).alias("l"), "i", "to", "new", "r", "shifts")).alias("b"))
    return better.select("_row", F.col("b.new").alias("h"), F.col("b.r").alias("r"), F.col("b.e").alias("d"), (F.col("b.shifts") + 1).alias("shifts"))


def with_ter_edits(df: DataFrame, keys: list[str], hyp: str = "prediction", ref: str = "reference", max_dist: int = MAX_DIST) -> DataFrame:
    """``(keys..., edits, ref_len)``: shifts and remaining word edits of every row. Null texts count as empty."""
    from tessera.session import ship_package

    ship_package(df.sparkSession)
    words = df.select(*keys, words_lower(F.col(hyp)).alias("_h"), words_lower(F.col(ref)).alias("_r"))
    coded = words.select(F.monotonically_increasing_id().alias("_row"), *keys, F.greatest(F.size("_r"), F.lit(0)).cast("long").alias("ref_len"),
                         coded_words("_h", "_r").alias("_c"))
    rows = cut_lineage(coded.select("_row", *keys, "ref_len", F.col("_c.h").alias("h"), F.col("_c.r").alias("r"), F.levenshtein("_c.h", "_c.r").alias("d")), "ter")
    state = rows.select("_row", "h", "r", "d", F.lit(0).alias("shifts"))
    ends = state
    while True:  # the distance falls in every round, so there are at most as many as the first distance
        state = cut_lineage(best_shifts(state.where("d > 1"), max_dist), "ter-round")  # one edit left is not worth a shift
        if state.isEmpty():
            break
        ends = ends.unionByName(state)
    found = ends.groupBy("_row").agg(F.min(F.col("d") + F.col("shifts")).cast("long").alias("edits")).withColumnRenamed("_row", "_r")
    return rows.join(found.hint("shuffle_merge"), F.col("_row") == F.col("_r")).select(*keys, "edits", "ref_len")


def corpus_ter(df: DataFrame, keys: list[str], hyp: str = "prediction", ref: str = "reference", max_dist: int = MAX_DIST) -> DataFrame:
    """Summed edits over summed reference words."""
    st = with_ter_edits(df, keys, hyp, ref, max_dist).agg(F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"), F.count(F.lit(1)).alias("n_rows"))
    return st.select(F.round(rate(F.col("edits"), F.col("ref_len")), 6).alias("ter"), "edits", "ref_len", "n_rows")
