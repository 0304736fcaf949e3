"""Operator 5: chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation several times, each snapshot with some turns more. Every turn
gets a hash of (its place, role, text); the rolling hash of a prefix is the sum of its
turns' hashes, in three 32-bit lanes. Sums over a conversation are taken by blocks of a
range partitioning that is written once, so a conversation with very many turns is spread
over tasks like any other. A conversation whose whole hash is the hash of a proper prefix of
a longer one is dropped by an anti-join, and of equal conversations the smallest id stays.

What stays is rendered turn by turn, in parts of at most ``part_turns`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import materialise, parallelism, prepare

LANES = ("s1", "s2", "s3")
PART_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct turns ``conv_id, turn, role, text`` of the conversations that have an id; null roles are ``unknown``, null texts empty."""
    return conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()


def place_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, h, turn, role`` with the place of every turn in its conversation (from 0), without its text.

    Order: turn number (null first), role, then a hash of the text.
    """
    order = ["conv_id", "turn", "role", "h"]
    narrow = turns.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("h"), F.xxhash64("text", "role").alias("h2"))
    ranged = narrow.repartitionByRange(parallelism(turns.sparkSession), *order, "h2").withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "turns")
    local = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order, "h2")) - 1
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "conv_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # a row per conversation and partition
    return materialise(ranged.withColumn("_local", local).join(offset, ["conv_id", "_part"]).withColumn(
        "place", F.col("_offset") + F.col("_local")).drop("_offset", "_local"), "places")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``conv_id, n, s1, s2, s3``: the rolling hash of each prefix of n turns, and whether it is the ``whole`` conversation."""
    lane = [F.xxhash64(F.lit(i), "place", "h", "h2").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(len(LANES))]
    turns = placed.select("conv_id", "_part", "place", *[x.alias(c) for x, c in zip(lane, LANES)])
    inside = Window.partitionBy("conv_id", "_part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = turns.groupBy("conv_id", "_part").agg(*[F.sum(c).alias(f"_{c}") for c in LANES], F.max("place").alias("_last")).select(
        "conv_id", "_part", F.max("_last").over(Window.partitionBy("conv_id")).alias("_last"),
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in LANES])
    rolled = turns.select("conv_id", "_part", "place", *[F.sum(c).over(inside).alias(c) for c in LANES])
    return rolled.join(carried, ["conv_id", "_part"]).select(
        "conv_id", (F.col("place") + 1).alias("n"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in LANES],
        (F.col("place") == F.col("_last")).alias("whole"))


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that no longer one continues; of equal ones the smallest id."""
    prefixes = materialise(prefix_hashes(placed), "prefixes")
    whole = prefixes.where("whole").groupBy("n", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = prefixes.where(~F.col("whole")).select("n", *LANES).distinct()
    return whole.join(proper, ["n", *LANES], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat format. The format's own marks in a role or text are split by a space after their first sign."""
    def safe(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))

    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(f"{CLOSE}\n"))


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, part, n_turns, n_copies, chat``: the maximal conversations, rendered.

    A conversation of up to ``part_turns`` turns is one row (part 0); a longer one goes on in
    parts 1, 2, ..., whose chats concatenate to the whole. ``n_turns`` counts the whole
    conversation's turns, ``n_copies`` the equal conversations it stands for. Rows without a
    conversation id are left out; repeated rows count once; turns with the same number
    follow each other by role and text hash; an empty table gives no rows. Other columns are not read.
    """
    prepare(conversations.sparkSession)
    turns = turns_of(conversations, conv_col, turn_col, role_col, text_col)
    placed = place_turns(turns)
    kept = maximal_conversations(placed)
    # the texts come back only for the conversations that stay
    spot = placed.join(kept, "conv_id").select("conv_id", "turn", "role", "h", "h2", "place", "n_turns", "n_copies")
    texts = turns.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("h"), F.xxhash64("text", "role").alias("h2"))
    same = [F.col("t.conv_id") == F.col("p.conv_id"), F.col("t.turn").eqNullSafe(F.col("p.turn")), F.col("t.role") == F.col("p.role"),
            F.col("t.h") == F.col("p.h"), F.col("t.h2") == F.col("p.h2")]
    rows = texts.alias("t").join(spot.alias("p"), same).select(
        "p.conv_id", (F.col("p.place") / part_turns).cast("long").alias("part"), "p.place", "p.n_turns", "p.n_copies",
        rendered(F.col("t.role"), F.col("t.text")).alias("line"))
    grouped = rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))  # at most part_turns of them
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("chat"))


ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn, role) AS l FROM t GROUP BY conv_id
), u AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n, l FROM c GROUP BY n, l
), p AS (
  SELECT DISTINCT l[1:i] AS l FROM u, range(1, n) AS g(i)
), kept AS (
  SELECT u.* FROM u ANTI JOIN p USING (l)
), placed AS (
  SELECT conv_id, n, n_copies, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS x FROM kept
)
SELECT conv_id, (place // 256)::BIGINT AS part, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
       string_agg('<|im_start|>' || replace(replace(x.r, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
                  || replace(replace(x.t, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY place) AS chat
FROM placed GROUP BY conv_id, place // 256, n, n_copies
"""
