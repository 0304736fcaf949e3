"""Operator 11: conversation structure repair by a square-root checkpointed dynamic program.

The rows of a conversation become a sequence of role initials of the form ``(s?(ua)+)?`` by the cheapest
edits. State-cost vectors (what it costs to finish from here, by the state reached) run
backwards over the rows. They are kept only at checkpoints, every ~ square root of n rows; the
blocks between are computed again while the edits are walked forward, each taking the ASCII-least
letter that is still tight.

On Spark a conversation's blocks are dealt out like any rows. For conversations of more
than one block, each block first gives its 4 x 4 table of least costs (state before, state after);
a conversation's tables chain to the vectors at its checkpoints. With its vector each block tells which state
it ends in for each it may start in; these chain to the states at the checkpoints. Then all blocks
emit their edits by themselves. So no task holds more than a block of texts, or one small row
per block of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.llm.common import materialise, parallelism, prepare

MIN_BLOCK = 256
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State after an inserted turn or one of a changed role.
FILL = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
FINISH = (0, 4, 2, 0)
REROLE, DELETE, INSERT = 2, 3, 2
FAR = 1 << 50
OUT_BYTES = 8 << 20


@lru_cache(maxsize=1 << 16)
def _step(initial: str, must: bool, cut: bool, after: tuple) -> tuple:
    keep = KEEP.get(initial, {})
    cost = []
    for q in range(4):
        best = DELETE + after[q]
        if not must:
            best = min(best, REROLE + cut + after[FILL[q]])
            if q in keep:
                best = min(best, cut + after[keep[q]])
        cost.append(best)
    cost[USER] = min(cost[USER], INSERT + cost[ASSISTANT])
    cost[ASSISTANT] = min(cost[ASSISTANT], INSERT + cost[USER])
    cost[START], cost[SYSTEM] = min(cost[START], INSERT + cost[USER]), min(cost[SYSTEM], INSERT + cost[USER])
    return tuple(min(c, FAR) for c in cost)


def step(row: tuple, after: tuple) -> tuple:
    """The vector before a row (initial, must go, truncated) from the one after it."""
    least = min(after)
    return tuple(c + least for c in _step(*row, tuple(c - least for c in after)))


def vectors(rows: list[tuple], end: tuple) -> list[tuple]:
    """The vectors before each row of a block, and the one at its end."""
    out = [end]
    for row in reversed(rows):
        out.append(step(row, out[-1]))
    return out[::-1]


def table_of(rows: list[tuple]) -> list[int]:
    """Least cost from each state before the block to each state at its end (16 numbers, FAR if there is no way)."""
    after = [vectors(rows, tuple(0 if q == e else FAR for q in range(4)))[0] for e in range(4)]
    return [min(after[e][q], FAR) for q in range(4) for e in range(4)]


def walk(rows: list[tuple], end: tuple, state: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """Edits (letter, row, state after) of a block from ``state``, and the state at its end. The last block also finishes."""
    cost = vectors(rows, end)
    edits, i = [], 0
    while i < len(rows) or last and FINISH[state] > 0:
        now = cost[i][state]
        if i == len(rows):
            state = FILL[state]
            edits.append(("I", i, state))
            continue
        initial, must, cut = rows[i]
        after = cost[i + 1]
        if now == DELETE + after[state]:
            edits.append(("D", i, state))
            i += 1
        elif now == INSERT + cost[i][FILL[state]]:
            state = FILL[state]
            edits.append(("I", i, state))
        else:
            to = KEEP.get(initial, {}).get(state)
            letter = "K" if to is not None and now == cut + after[to] else "R"
            state = to if letter == "K" else FILL[state]
            edits.append((letter, i, state))
            i += 1
    return edits, state


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def packed(rows: Iterator[tuple], schema: pa.Schema, weigh=lambda r: 64) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weigh(r)
        if len(held) >= 4096 or size >= OUT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(df: DataFrame, fields: str) -> tuple[pa.Schema, T.StructType]:
    """Schema ``conv_id`` (as in ``df``) and ``fields``, for Arrow and for Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType)] + T.StructType.fromDDL(fields).fields)
    return to_arrow_schema(spark_schema), spark_schema


def damaged_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn``, modulo 20. Null roles and texts are one space."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(filled(text_col), "[.!?]", "")).otherwise(filled(text_col))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                F.when(fault == 4, "user").otherwise(filled(role_col)).alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))).alias("again"))


def plain_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows as they are. Null roles and texts are one space."""
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), F.lit(0).alias("again"))


def placed_rows(rows: DataFrame, min_block: int) -> tuple[DataFrame, DataFrame]:
    """The rows in range order, written once, and per (conv_id, _part) what places them: ``base, offset, n, size`` (rows per block).

    Order: turn (null first), role, md5 of the text; equal rows stay beside each other.
    """
    order = ["conv_id", "turn", "role", "digest", "_row"]
    ranged = rows.select("conv_id", "turn", "role", "text", F.md5("text").alias("digest"),
                         (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
                         (F.monotonically_increasing_id() * 2 + F.col("again")).alias("_row"))
    ranged = ranged.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order).drop("_row").withColumn(
        "_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "repair-rows")
    per = Window.partitionBy("conv_id")  # a row for each partition that the conversation reaches
    before = per.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spots = ranged.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("base")).select(
        "conv_id", "_part", "base", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"), F.sum("_n").over(per).alias("n"))
    return ranged, spots.withColumn("size", F.greatest(F.lit(min_block), F.ceil(F.sqrt("n"))).cast("long"))


def with_places(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """Adds ``place`` (from 0), ``block`` and ``whole`` (the conversation is one block)."""
    s = spots.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_its"), "base", "offset", "n", "size")
    place = F.col("_at") - F.col("base") + F.col("offset")
    return rows.join(s, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_its"))).withColumn("place", place).withColumn(
        "block", (F.col("place") / F.col("size")).cast("long")).withColumn("whole", F.col("n") <= F.col("size")).drop("_conv", "_its", "base", "offset", "size", "_at", "_part")


def same_conversation(a: DataFrame, b: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """Join on the conversation (null is one, too) and ``keys``; the columns of ``a`` and what ``b`` adds."""
    named = b.select(*[F.col(c).alias(f"_b_{c}") if c in ("conv_id", *keys) else F.col(c) for c in b.columns])
    on = F.col("conv_id").eqNullSafe(F.col("_b_conv_id"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_b_{k}"))
    return a.join(named, on, how).drop("_b_conv_id", *[f"_b_{k}" for k in keys])


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Blocks of rows, each in order in one task."""
    return rows.select("conv_id", "block", *columns).repartition(parallelism(rows.sparkSession), "conv_id", "block").sortWithinPartitions("conv_id", "block", "place")


def checkpoints(long_rows: DataFrame) -> DataFrame:
    """``conv_id, block, state, costs, last, repeats`` for the blocks of long conversations: the state before the block, the
    vector at its end, and the places whose role and text came earlier."""
    firsts = long_rows.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("conv_id", "place", F.lit(True).alias("fresh"))
    marked = same_conversation(long_rows, firsts, "place").select(
        "conv_id", "block", "place", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("fresh").isNull()).alias("must"), "cut", "blank")
    marked = materialise(marked, "repair-long")
    columns = ("place", "initial", "must", "cut")

    schema, kind = _arrow(long_rows, "block long, costs array<long>")

    def tables(batches):
        return packed(((r[0][0], r[0][1], table_of([x[3:] for x in r])) for r in runs(batches, 2)), schema)

    def backward(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("block", "costs", "conv_id"))), key=lambda r: r[0])
        out, end = [], FINISH
        for block, t, conv in reversed(rows):
            out.append((conv, block, list(end)))
            end = tuple(min(t[4 * q + e] + end[e] for e in range(4)) for q in range(4))
        return pa.Table.from_batches([_batch(out, schema)])

    ends = materialise(dealt(marked, *columns).mapInArrow(tables, kind).groupBy("conv_id").applyInArrow(backward, kind), "repair-ends")

    # the vector leads its block's rows
    lead = ends.select("conv_id", "block", F.lit(-1).cast("long").alias("place"), F.lit("").alias("initial"), F.lit(False).alias("must"), F.lit(False).alias("cut"), "costs")
    led = dealt(marked.withColumn("costs", F.lit(None).cast("array<long>")).unionByName(lead, allowMissingColumns=True), *columns, "costs")

    def outcomes(batches):
        def all_states():
            for r in runs(batches, 2):
                rows, end = [x[3:6] for x in r[1:]], tuple(r[0][6])
                yield r[0][0], r[0][1], [walk(rows, end, q, False)[1] for q in range(4)]
        return packed(all_states(), schema)

    state_schema, state_kind = _arrow(long_rows, "block long, state int, last boolean")

    def forward(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("block", "costs", "conv_id"))), key=lambda r: r[0])
        out, state = [], START
        for block, to, conv in rows:
            out.append((conv, block, state, block == rows[-1][0]))
            state = to[state]
        return pa.Table.from_batches([_batch(out, state_schema)])

    states = led.mapInArrow(outcomes, kind).groupBy("conv_id").applyInArrow(forward, state_kind)
    repeats = marked.where("must and not blank").groupBy("conv_id", "block").agg(F.collect_list("place").alias("repeats"))  # at most a block of them
    return same_conversation(same_conversation(states, ends, "block", how="inner"), repeats, "block")


PIECE = ("block long, whole boolean, first_turn long, last_turn long, low long, turns long, first string, last string, blank long, duplicate long, "
         "truncated long, illegal long, cost long, audit string, body string, repaired_sha256 string, empty boolean")


def _pieces(batches, schema):
    """One row per block: its counts, edits and repaired text (of a whole conversation only the hash)."""
    def rows():
        for r in runs(batches, 2):
            conv, block = r[0][:2]
            lead = r.pop(0) if r[0][2] < 0 else None
            whole = lead is None
            state, end, last, repeats = (START, FINISH, True, None) if whole else (lead[8], tuple(lead[9]), lead[10], set(lead[11] or ()))
            seen, faults, codes = set(), [0, 0, 0], []
            for _, _, place, _, role, text, blank, cut, *_ in r:
                again = not blank and ((role, text) in seen if whole else place in repeats)
                if whole:
                    seen.add((role, text))
                if blank or again or cut:
                    faults[0 if blank else 1 if again else 2] += 1
                codes.append((role[:1], blank or again, cut))
            edits, _ = walk(codes, end, state, last)
            cost, lines = 0, []
            for letter, i, to in edits:
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (letter in "KR" and codes[i][2])
                if letter != "D":
                    role = r[i][4] if letter == "K" else ROLE[to]
                    lines.append(f"{role}:{'' if letter == 'I' else r[i][5]}")
            turns = [x[3] for x in r if x[3] is not None]
            body = "\n".join(lines)
            yield (conv, block, whole, turns[0] if turns else None, turns[-1] if turns else None, turns[0] if turns else None, len(set(turns)),
                   codes[0][0], codes[-1][0], *faults, sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:])), cost, "".join(e[0] for e in edits),
                   None if whole else body, hashlib.sha256(body.encode()).hexdigest() if whole else None, not lines)

    return packed(rows(), schema, lambda r: 256 + len(r[15] or ""))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches, schema):
    """One row per long conversation from the rows of its blocks, in order; the text goes through the hash block by block."""
    def blocks():
        names, held = None, None
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):  # one block's text at a time
                yield {n: batch.column(n)[i].as_py() for n in names}

    def rows():
        at, total = None, None
        for b in blocks():
            if at is None or at["conv_id"] != b["conv_id"]:
                if at is not None:
                    yield finish(total)
                total = {"conv_id": b["conv_id"], "low": None, "high": None, "turns": 0, "sums": [0] * 5, "audit": [], "hash": hashlib.sha256(), "any": False}
                at = None
            if b["low"] is not None:
                total["turns"] += b["turns"] - (total["high"] is not None and total["high"] == b["first_turn"])
                total["low"] = b["low"] if total["low"] is None else total["low"]
                total["high"] = b["last_turn"]
            for j, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                total["sums"][j] += b[c]
            if at is not None and at["last"] + b["first"] not in LEGAL:
                total["sums"][3] += 1
            total["audit"].append(b["audit"])
            if not b["empty"]:
                total["hash"].update((("\n" if total["any"] else "") + b["body"]).encode())
                total["any"] = True
            at = {"conv_id": b["conv_id"], "last": b["last"]}
        if at is not None:
            yield finish(total)

    def finish(t):
        gaps = 0 if t["low"] is None else t["high"] - t["low"] + 1 - t["turns"]
        return (t["conv_id"], gaps, *t["sums"], "".join(t["audit"]), t["hash"].hexdigest())

    return packed(rows(), schema)


def repair_conversations(conversations: DataFrame, damage: bool = False, min_block: int = MIN_BLOCK, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    The edits bring the role initials into the form ``(s?(ua)+)?`` at least cost, the ASCII-least of equal ones. Rows without a
    conversation id are one conversation. Null roles and texts are one space (such a text is blank, such a role no
    known one); rows are taken by turn (null first), then role and md5 of the text, so equal rows count as duplicates. A very long
    text is held with its block only. ``damage`` first applies the test damage; a conversation left without rows has
    zeros, an empty audit and the hash of the empty string. An empty table gives no rows. Other columns are not read.
    """
    prepare(conversations.sparkSession)
    names = (conv_col, turn_col, role_col, text_col)
    rows = (damaged_rows if damage else plain_rows)(conversations, *names)
    ranged, spots = placed_rows(rows, min_block)
    spots = materialise(spots, "repair-spots")
    long_rows = with_places(ranged.drop("text"), spots.where("n > size")).select("conv_id", "block", "place", "role", "digest", "blank", "cut")
    lead = checkpoints(materialise(long_rows, "repair-narrow"))
    nothing = F.lit(None)
    rows = with_places(ranged, spots).select("conv_id", "block", "place", "turn", "role", "text", "blank", "cut", nothing.cast("int").alias("state"),
                                             nothing.cast("array<long>").alias("costs"), nothing.cast("boolean").alias("last"), nothing.cast("array<long>").alias("repeats"))
    lead = lead.withColumn("place", F.lit(-1).cast("long"))
    led = dealt(rows.unionByName(lead, allowMissingColumns=True), "place", "turn", "role", "text", "blank", "cut", "state", "costs", "last", "repeats")
    schema, kind = _arrow(ranged, PIECE)
    pieces = materialise(led.mapInArrow(lambda b: _pieces(b, schema), kind), "repair-pieces")
    report_schema, report_kind = _arrow(ranged, REPORT)
    one = pieces.where("whole").withColumn("gaps", F.coalesce(F.col("last_turn") - F.col("low") + 1 - F.col("turns"), F.lit(0)))
    more = (pieces.where("not whole").repartition(parallelism(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
            .mapInArrow(lambda b: _joined(b, report_schema), report_kind))
    found = one.select(*report_kind.names).unionByName(more)
    every = conversations.select(F.col(conv_col).alias("conv_id")).distinct()
    out = same_conversation(every, found.withColumn("_there", F.lit(True)))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same by a recursion over the rows of all conversations at once, backwards for the vectors and forwards for the edits.
ORACLE_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), keyed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, j: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS fault FROM raw
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, again
  FROM keyed, range(2) AS g(again) WHERE fault <> 0 AND (again = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged
), flags AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS is_cut FROM placed
), r AS MATERIALIZED (
  SELECT *, is_blank OR is_again AS must, is_cut::INT AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM flags
), back AS (
  SELECT conv_id, n + 1 AS i, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM (SELECT DISTINCT conv_id, n FROM r)
  UNION ALL
  SELECT conv_id, i, least(b0, 2 + d2), least(b1, 2 + d2), d2, least(b3, 2 + d2) FROM (
    SELECT *, least(b2, 2 + b3) AS d2 FROM (
      SELECT r.conv_id, r.i,
        least(3 + c0, CASE WHEN must THEN 1000000000 ELSE least(2 + cut + c2, CASE initial WHEN 's' THEN cut + c1 WHEN 'u' THEN cut + c2 ELSE 1000000000 END) END) AS b0,
        least(3 + c1, CASE WHEN must THEN 1000000000 ELSE least(2 + cut + c2, CASE initial WHEN 'u' THEN cut + c2 ELSE 1000000000 END) END) AS b1,
        least(3 + c2, CASE WHEN must THEN 1000000000 ELSE least(2 + cut + c3, CASE initial WHEN 'a' THEN cut + c3 ELSE 1000000000 END) END) AS b2,
        least(3 + c3, CASE WHEN must THEN 1000000000 ELSE least(2 + cut + c2, CASE initial WHEN 'u' THEN cut + c2 ELSE 1000000000 END) END) AS b3
      FROM back JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1))
), v AS MATERIALIZED (
  SELECT conv_id, i, [c0, c1, c2, c3] AS c FROM back
), forth AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines, false AS done FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, CASE WHEN letter IN ('I', '') THEN i ELSE i + 1 END, q2, audit || letter,
         CASE letter WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, fill || ':' || text)
                     WHEN 'I' THEN list_append(lines, fill || ':') ELSE lines END, letter = ''
  FROM (
    SELECT *, CASE letter WHEN 'K' THEN kept WHEN 'D' THEN q WHEN '' THEN q ELSE filled END AS q2 FROM (
      SELECT *, CASE WHEN last AND c[q] = 0 THEN '' WHEN last THEN 'I' WHEN c[q] = 3 + after[q] THEN 'D' WHEN c[q] = 2 + c[filled] THEN 'I'
                     WHEN NOT must AND kept IS NOT NULL AND c[q] = cut + after[kept] THEN 'K' ELSE 'R' END AS letter FROM (
        SELECT f.*, r.role, r.text, r.must, r.cut, r.i IS NULL AS last, v.c AS c, w.c AS after, CASE q WHEN 3 THEN 4 ELSE 3 END AS filled,
               CASE q WHEN 3 THEN 'assistant' ELSE 'user' END AS fill,
               CASE WHEN initial = 's' AND q = 1 THEN 2 WHEN initial = 'u' AND q <> 3 THEN 3 WHEN initial = 'a' AND q = 3 THEN 4 END AS kept
        FROM forth f JOIN v ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.i = f.i
        LEFT JOIN v w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i + 1
        LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i
        WHERE NOT f.done)))
), ended AS (
  SELECT conv_id, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM forth WHERE done
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
         count(*) FILTER (NOT is_blank AND is_again) AS duplicate, count(*) FILTER (NOT is_blank AND NOT is_again AND is_cut) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.c[1], 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM a.conv_id AND v.i = 1
"""
