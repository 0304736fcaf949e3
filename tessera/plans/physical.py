"""Plan choices shared by the operators.

* ``bounded_broadcast``: broadcast a side only after counting it against a limit;
  beyond the limit the join stays a shuffle join (AQE may still split skew).
* ``dense_row_number`` / ``group_row_number``: row numbers in a given order, over all rows or within
  groups, without a window over them: a range partitioning written once, and offsets by partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F


# Limits below which a lookup table is shipped to every task.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20


def bounded_broadcast(df: DataFrame, max_rows: int | None = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Return ``(df, True)`` wrapped in a broadcast hint when it has at most ``max_rows`` rows
    and at most ``max_bytes`` bytes of string data.

    The side is written to the shared folder first, so the join reads what the check counted
    and nothing stays in executor memory; rows and string bytes are counted in one aggregate.
    ``max_rows=None`` skips the check and leaves the choice to Catalyst/AQE (their own size threshold).
    """
    if max_rows is None:
        return df, False
    df = cut_lineage(df, "lookup")
    strings = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    size = sum(strings, F.lit(0)) if strings else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    if row.n <= max_rows and row.b <= max_bytes:
        return F.broadcast(df), True
    return df, False


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it comes from fewer files than there are shuffle partitions, so that work per row uses all
    cores; data in many files stays where it is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if len(df.inputFiles()) < n else df


def dealt_by_rows(written: DataFrame, rows: int) -> DataFrame:
    """A written table dealt out evenly to tasks of at most about ``rows`` rows, and at least as many as there are shuffle partitions."""
    n = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written.repartition(max(n, -(-written.count() // rows)))


#: monotonically_increasing_id counts from 0 in each partition, above the partition's number.
ID_BITS = 33


def written_in_order(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written once, with ``_part`` (partition) and ``_in`` (place in it, from 0).

    The written numbers stay as they are however often and in whatever part the table is read.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged, "ordered")
    return ranged.withColumn("_part", F.shiftright("_at", ID_BITS)).withColumn("_in", F.col("_at").bitwiseAND((1 << ID_BITS) - 1)).drop("_at")


def dense_row_number(df: DataFrame, order: list, name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Add a 0-based dense row number following ``order`` (ascending columns, a total order; nulls first).

    A row's number is its place in its partition of ``written_in_order`` plus the rows of the partitions before (one
    row per partition, broadcast). The size of the plan does not depend on the number of partitions.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"_k{i}" for i in range(len(cols))]
    placed = written_in_order(df.select("*", *[c.alias(k) for c, k in zip(cols, keys)]), keys, partitions)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_off") + F.col("_in")).alias(name))


def group_row_number(df: DataFrame, group: list[str], order: list[str], name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Add a 0-based dense row number within each group (null is a group, too), following ``order``.

    No window runs over a group's rows: a group is cut by the range partitioning like any rows, and only one row per
    group and partition is windowed, so a group with a third of all rows is numbered by many tasks.
    """
    placed = written_in_order(df, [*group, *order], partitions)
    per = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spots = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_base")).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), "_base", F.coalesce(F.sum("_n").over(per), F.lit(0)).alias("_off"))
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(spots, on).select(*df.columns, (F.col("_in") - F.col("_base") + F.col("_off")).alias(name))


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the cluster's shared folder and read it back: later uses read the same rows."""
    from tessera.session import shared_folder

    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
