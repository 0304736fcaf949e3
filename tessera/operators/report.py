"""Reports over the hub table ``(id..., source, reference, prediction)``.

Everything is a distributed aggregate: per-row statistics, then sums that
combine map-side; nothing is gathered on the driver but the final rows. ``evaluation_report`` takes
all metrics for all rows, directions and length buckets from one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions import text as tx
from tessera.functions.tok13a import tokenize_13a
from tessera.operators.metrics.ngrams import BLEU_STAT_COLS, CHRF_STAT_COLS, sum_stats, with_bleu_stats, with_chrf_stats
from tessera.operators.metrics.rows import summed, with_row_stats
from tessera.operators.metrics.scores import bleu_exp, bleu_unsmoothed, chrf, r6
from tessera.plans.physical import group_row_number


def corpus_profile(pairs: DataFrame, a: str = "src", b: str = "tgt") -> DataFrame:
    """A3: row count and mean character length of both sides."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        r6(F.avg(tx.char_length(a))).alias(f"avg_chars_{a}"),
        r6(F.avg(tx.char_length(b))).alias(f"avg_chars_{b}"),
    )


def split_counts(df: DataFrame, by: str = "split") -> DataFrame:
    """Rows per group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))


def _stats(hub: DataFrame, keep: list[str], rstrip: bool) -> DataFrame:
    return with_bleu_stats(hub, keep, tokenize_13a(F.col("prediction"), rstrip), tokenize_13a(F.col("reference"), rstrip))


def bleu_by_length(hub: DataFrame) -> DataFrame:
    """BLEU (unsmoothed, 0-1), count and share per source-length bucket; empty buckets left out."""
    b = hub.withColumn("bucket", tx.length_bucket(tx.word_count(F.col("source"))))
    st = sum_stats(_stats(b, ["bucket"], rstrip=False), BLEU_STAT_COLS, ["bucket"])
    # three rows at most: the window over them is tiny
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))
    return st.select("bucket", r6(bleu_unsmoothed()).alias("bleu"), F.col("n_rows").alias("count"),
                     r6(tx.percentage(F.col("n_rows"), total)).alias("percentage"))


def bleu_by_direction(examples: DataFrame) -> DataFrame:
    """Corpus BLEU (exp-smoothed, 0-100) per direction."""
    st = sum_stats(_stats(examples, ["direction"], rstrip=True), BLEU_STAT_COLS, ["direction"])
    return st.select("direction", r6(bleu_exp()).alias("bleu"), F.col("n_rows").alias("count"))


def error_analysis(hub: DataFrame, lo: int = 0x0F00, hi: int = 0x0FFF) -> DataFrame:
    """A11 (mean word-count difference) and A12 (share of predictions holding script characters)."""
    return hub.agg(
        r6(F.avg(tx.word_count(F.col("prediction")) - tx.word_count(F.col("reference")))).alias("avg_length_diff"),
        r6(F.avg(tx.contains_script(F.col("prediction"), lo, hi).cast("int")) * 100.0).alias("untranslated_percentage"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def corpus_scores(hub: DataFrame) -> DataFrame:
    """BLEU (0-1 and smoothed 0-100) and chrF. Each statistic is summed over the rows by
    itself; only the two rows of sums meet."""
    b = sum_stats(with_bleu_stats(hub, [], tokenize_13a(F.col("prediction")), tokenize_13a(F.col("reference"))), BLEU_STAT_COLS)
    c = sum_stats(with_chrf_stats(hub, [], F.col("prediction"), F.col("reference")), CHRF_STAT_COLS).drop("n_rows")
    st = b.withColumn("_one", F.lit(1)).join(c.withColumn("_one", F.lit(1)), "_one")
    return st.select(r6(bleu_unsmoothed()).alias("bleu"), r6(bleu_exp()).alias("bleu_smoothed"),
                     r6(chrf()).alias("chrf"), "n_rows")


def epoch_loss(history: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Mean loss per run and epoch (partial aggregation: hot runs are pre-summed per task)."""
    return history.groupBy(run, epoch).agg(r6(F.avg(loss)).alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))


def numbered_batches(history: DataFrame, run: str = "run", epoch: str = "epoch", step: str = "step", batch_col: str = "batch_idx") -> DataFrame:
    """The place of each batch in its run's epoch, from 0 in the order of ``step``. A run with most rows is numbered by many tasks."""
    return group_row_number(history, [run, epoch], [step], batch_col)


def logged_batches(history: DataFrame, every: int, batch_col: str = "batch_idx") -> DataFrame:
    """The rows a logger with interval ``every`` would keep."""
    return history.where(F.col(batch_col) % every == 0)


def best_so_far(history: DataFrame, run: str = "run", step: str = "step", score: str = "bleu",
                block: int = 1 << 16, start: float = 0.0) -> DataFrame:
    """Flag rows whose score is strictly above every earlier score of the run (and ``start``).

    A running maximum as a two-level blocked prefix scan, so no window partition
    holds more than ``block`` rows, however large one run is:
    (1) maxima per (run, block) and per (run, block of blocks) - partial aggregates;
    (2) carry-in of each super-block (a window over the super-block maxima), then of
        each block inside its super-block (a window of at most ``block`` rows);
    (3) the running maximum inside each (run, block), plus the block's carry-in.
    """
    # rows without a run or step are kept; they are never best and do not count for others
    counts = F.col(run).isNotNull() & F.col(step).isNotNull()
    b1 = F.floor(F.col(step) / F.lit(block)).cast("long")
    h = history.withColumn("_b1", b1).withColumn("_b2", F.floor(F.col("_b1") / F.lit(block)).cast("long"))
    placed = h.where(counts)
    m1 = placed.groupBy(run, "_b2", "_b1").agg(F.max(score).alias("_m1"))
    m2 = m1.groupBy(run, "_b2").agg(F.max("_m1").alias("_m2"))
    before = Window.unboundedPreceding
    c2 = m2.select(run, "_b2", F.max("_m2").over(Window.partitionBy(run).orderBy("_b2").rowsBetween(before, -1)).alias("_c2"))
    w1 = Window.partitionBy(run, "_b2").orderBy("_b1").rowsBetween(before, -1)
    c1 = (m1.join(c2, [run, "_b2"])
          .select(run, "_b1", F.greatest(F.max("_m1").over(w1), F.col("_c2")).alias("_carry")))
    j = placed.join(c1, [run, "_b1"])
    wi = Window.partitionBy(run, "_b1").orderBy(step).rowsBetween(before, -1)
    prev = F.greatest(F.max(score).over(wi), F.col("_carry"), F.lit(start))
    flagged = j.withColumn("is_best", F.coalesce(F.col(score) > prev, F.lit(False)))
    out = [*history.columns, "is_best"]
    return flagged.select(*out).unionByName(h.where(~counts).withColumn("is_best", F.lit(False)).select(*out))


def final_best(history: DataFrame, run: str = "run", step: str = "step", score: str = "bleu") -> DataFrame:
    """The best score per run and the first step reaching it."""
    first = F.when(F.col(score).isNotNull(), F.struct(-F.col(score), F.col(step)))  # rows without a score name no step
    return history.groupBy(run).agg(F.max(score).alias("best"), F.min_by(step, first).alias("best_step"))


def evaluation_report(examples: DataFrame, lo: int = 0x0F00, hi: int = 0x0FFF) -> DataFrame:
    """A4-A9a and A11-A14 in one pass over ``examples`` (``direction, source, reference, prediction``).

    The row statistics are summed under GROUPING SETS, so one shuffle of a few rows per task gives a row for all examples
    (``level`` "all"), one per direction, per source-length bucket, and per direction and bucket. Empty groups are left out;
    no examples give one row "all" with no scores.
    """
    rows = with_row_stats(examples, ["direction"], lo=lo, hi=hi)
    sets = [[], ["direction"], ["bucket"], ["direction", "bucket"]]
    st = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col("direction"), F.col("bucket")).agg(
        F.grouping_id("direction", "bucket").alias("_g"), *summed())
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "direction").when(F.col("_g") == 2, "bucket").otherwise("direction, bucket")
    return st.select(level.alias("level"), "direction", "bucket", "n_rows", *report_scores())


def report_scores() -> list:
    """The metrics as columns over summed row statistics."""
    from tessera.operators.metrics.edit import rate

    n = F.col("n_rows")
    return [r6(bleu_unsmoothed()).alias("bleu"), r6(bleu_exp(get=lambda c: F.col(f"s_{c}"))).alias("bleu_smoothed"), r6(chrf()).alias("chrf"),
            r6("meteor_exact").alias("meteor_exact"), r6("meteor_exact_stem").alias("meteor_exact_stem"),
            r6(rate(F.col("edits"), F.col("ref_words"))).alias("wer"), r6(F.col("word_diff") / n).alias("avg_length_diff"),
            r6(F.col("script") * 100.0 / n).alias("untranslated_percentage")]


def full_report(hub: DataFrame, keys: list[str], lo: int = 0x0F00, hi: int = 0x0FFF) -> DataFrame:
    """A10-A13 in one row: metrics, error analysis and the length table (D9), from one pass over the hub."""
    st = with_row_stats(hub, [], lo=lo, hi=hi).groupingSets([[], [F.col("bucket")]], F.col("bucket")).agg(F.grouping_id("bucket").alias("_all"), *summed())
    scores = st.select("_all", "bucket", F.col("n_rows").alias("count"), *report_scores())
    whole = F.col("_all") == 1

    def of_all(*names):
        return [F.max(F.when(whole, F.col(c))).alias(c) for c in names]

    one = scores.agg(*of_all("bleu", "bleu_smoothed", "meteor_exact", "meteor_exact_stem", "chrf", "wer", "avg_length_diff", "untranslated_percentage", "count"),
                     F.array_sort(F.collect_list(F.when(~whole, F.struct("bucket", "bleu", "count")))).alias("_buckets"))
    return one.select(
        F.struct("bleu", "bleu_smoothed", "meteor_exact", "meteor_exact_stem", "chrf", "wer").alias("metrics"),
        F.struct("avg_length_diff", "untranslated_percentage").alias("error_analysis"),
        F.transform("_buckets", lambda b: F.struct(b["bucket"].alias("bucket"), b["bleu"].alias("bleu"), b["count"].alias("count"),
                                                   r6(tx.percentage(b["count"], F.col("count"))).alias("percentage"))).alias("length_analysis"))


def direction_report(examples: DataFrame, keys: list[str], n_examples: int = 10) -> DataFrame:
    """K5 content: per direction, corpus BLEU (A14) and the first ``n_examples`` examples (L3)
    in key order. The examples come from a group limit (at most n per direction and task)."""
    scores = bleu_by_direction(examples)
    w = Window.partitionBy("direction").orderBy(*keys)
    head = examples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n_examples)
    firsts = head.groupBy("direction").agg(
        F.sort_array(F.collect_list(F.struct("_rn", *keys, "source", "reference", "prediction"))).alias("_ex"))
    return scores.join(firsts, "direction").select(
        "direction", "bleu", "count", F.transform("_ex", lambda e: e.dropFields("_rn")).alias("examples"))
