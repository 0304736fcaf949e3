"""Operator 13: vector code compression by dual-tree Lloyd rounds.

Vectors are scaled to integers and cut into equal consecutive parts, each with a codebook of its
own. They are written once in blocks; a block holds, for each part position, its parts in the
order of a balanced tree (split at the median of the widest component, level by level).

A round sends the codebooks (their size depends on the dimension alone) to the blocks. There a tree over the
parts and a tree over the entries go down together: for a pair of nodes the least and the
greatest squared distance between their boxes bound all distances, so entry nodes that cannot
hold the nearest entry are dropped; a part node that is left with one entry is assigned whole, by
its cached sum and count; what is still uncertain in the leaves is settled by integer distances.
All bounds are integers too, so the result is exactly that of plain assignment. Sums and counts
by (position, entry, component) are added up by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.common import materialise, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components are held within this, so that sums of a block stay below a long.
CLAMP = 1 << 40
LEAF = 24
BLOCK = 8192
MOST = (1 << 63) - 1
#: Labels that hold more than one in so many rows are joined by broadcast; there are at most so many.
HOT_SHARE = 1000


def split_points(n: int, level: int) -> np.ndarray:
    """Bounds of the 2^level nodes of a balanced tree over n places."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def exact_kind(*arrays: np.ndarray):
    """int64 if all squared distances between the rows fit, else Python integers."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return np.int64 if 4 * most * most * max(1, arrays[0].shape[1]) < 1 << 62 else object


def tree_order(points: np.ndarray, levels: int) -> np.ndarray:
    """The places of the points in tree order: every node is cut at the median of its widest component."""
    order = np.arange(len(points))
    for level in range(levels):
        cut = split_points(len(points), level)
        p = points[order]
        node = np.repeat(np.arange(1 << level), np.diff(cut))
        full = np.flatnonzero(np.diff(cut) > 0)
        widest = np.zeros(1 << level, np.int64)
        wide = np.maximum.reduceat(p, cut[full], axis=0) - np.minimum.reduceat(p, cut[full], axis=0)
        widest[full] = wide.argmax(axis=1)
        order = order[np.lexsort((p[np.arange(len(p)), widest[node]], node))]
    return order


class Tree:
    """Boxes, sums and counts of all levels over points that lie in tree order."""

    def __init__(self, points: np.ndarray, levels: int):
        self.points, self.levels = points, levels
        cut = split_points(len(points), levels)
        filled = np.diff(cut) > 0
        at = cut[:-1][filled]
        shape = (1 << levels, points.shape[1])
        lo, hi, total = (np.zeros(shape, points.dtype) for _ in range(3))
        lo[filled], hi[filled], total[filled] = (f.reduceat(points, at, axis=0) for f in (np.minimum, np.maximum, np.add))
        self.boxes = [(lo, hi, total, np.diff(cut))]
        for _ in range(levels):
            n = self.boxes[0][3]
            left, right = n[0::2] > 0, n[1::2] > 0
            both = (left & right)[:, None]
            a, b = lo[0::2], lo[1::2]
            lo = np.where(both, np.minimum(a, b), np.where(left[:, None], a, b))
            a, b = hi[0::2], hi[1::2]
            hi = np.where(both, np.maximum(a, b), np.where(left[:, None], a, b))
            total = total[0::2] + total[1::2]
            self.boxes.insert(0, (lo, hi, total, n[0::2] + n[1::2]))


def bounds(q_lo, q_hi, e_lo, e_hi):
    """Least and greatest squared distance between boxes: (nodes, entry nodes) each."""
    a, b = e_lo[None] - q_hi[:, None], q_lo[:, None] - e_hi[None]
    gap = np.maximum(np.maximum(a, b), 0)
    far = np.maximum(e_hi[None] - q_lo[:, None], q_hi[:, None] - e_lo[None])
    return (gap * gap).sum(axis=2), (far * far).sum(axis=2)


def beaten(q_lo, q_hi, entries, best):
    """(nodes, entries): True where every point of the box is strictly nearer to the node's ``best`` entry."""
    away = entries[None] - entries[best][:, None]
    square = (entries * entries).sum(axis=1)
    return square[None] - square[best][:, None] - 2 * np.maximum(away * q_lo[:, None], away * q_hi[:, None]).sum(axis=2) > 0


def assign(parts: Tree, entries: np.ndarray, codes: np.ndarray | None = None):
    """Sums and counts by entry; fills ``codes`` (in tree order) if given. Ties go to the lower entry."""
    kind, n, k = parts.points.dtype, len(parts.points), len(entries)
    order = tree_order(entries, max(0, int(k - 1).bit_length()))
    known = Tree(entries[order], max(0, int(k - 1).bit_length()))
    where = np.zeros(1 << known.levels, np.int64)
    leaf = split_points(k, known.levels)
    where[np.diff(leaf) > 0] = order[leaf[:-1][np.diff(leaf) > 0]]
    sums, counts = np.zeros((k, parts.points.shape[1]), kind), np.zeros(k, np.int64)
    none = np.array(MOST if kind == np.int64 else 1 << 200, kind)
    level, depth = 0, 0
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, 1), bool)
    while len(nodes):
        q_lo, q_hi, q_sum, q_n = (x[nodes] for x in parts.boxes[level])
        e_lo, e_hi, _, e_n = known.boxes[depth]
        open_ &= e_n > 0
        near, far = bounds(q_lo, q_hi, e_lo, e_hi)
        open_ &= near <= np.where(open_, far, none).min(axis=1)[:, None]
        if depth == known.levels:
            best = np.where(open_, far, none).argmin(axis=1)
            open_ &= ~beaten(q_lo, q_hi, e_lo, best)
            one = open_.sum(axis=1) == 1
            won = where[open_[one].argmax(axis=1)]
            np.add.at(sums, won, q_sum[one])
            np.add.at(counts, won, q_n[one])
            if codes is not None:
                cut = split_points(n, level)
                for i, e in zip(nodes[one].tolist(), won.tolist()):
                    codes[cut[i]:cut[i + 1]] = e
            nodes, open_ = nodes[~one], open_[~one]
            if level == parts.levels:
                break
        if depth < known.levels:
            open_, depth = np.repeat(open_, 2, axis=1), depth + 1
        if level < parts.levels:
            nodes, level = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), level + 1
            open_ = np.repeat(open_, 2, axis=0)
    if len(nodes):  # uncertain leaves
        cut = split_points(n, parts.levels)
        size = cut[nodes + 1] - cut[nodes]
        ends = np.cumsum(size)
        rows = np.arange(ends[-1]) + np.repeat(cut[nodes] - (ends - size), size)
        points, asked = parts.points[rows], np.repeat(open_, size, axis=0)
        found = np.full((len(rows), k), none, kind)
        for j in np.flatnonzero(open_.any(axis=0)).tolist():
            gap = points[asked[:, j]] - entries[where[j]]
            found[asked[:, j], where[j]] = (gap * gap).sum(axis=1)
        won = found.argmin(axis=1)
        if codes is not None:
            codes[rows] = won
        np.add.at(sums, won, points)
        np.add.at(counts, won, 1)
    return sums, counts


def scaled(vector: Column) -> Column:
    """floor(4096 x) of each component."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(CLAMP)), F.lit(-CLAMP)))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _pack(order: list[np.ndarray], parts: list[np.ndarray]) -> tuple[bytes, bytes]:
    return np.concatenate(order).astype(np.int32).tobytes(), np.concatenate([p.ravel() for p in parts]).tobytes()


def _trees(batches, width: int):
    """Rows of (ids, labels, order, parts): each batch with the parts of every position in tree order."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            n = rows.num_rows
            vectors = rows.column("v")
            flat, size = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
            cells = np.zeros((n, PARTS * width), np.int64)
            cells[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            order, parts = [], []
            for p in range(PARTS):
                own = cells[:, p * width:(p + 1) * width]
                order.append(tree_order(own, _levels(n)))
                parts.append(own[order[-1]])
            spot = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray)
                                             else rows.column(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*spot, *(pa.array([x], pa.binary()) for x in _pack(order, parts))], names=["ids", "labels", "tree", "parts"])


def _levels(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def _blocks(batch: pa.RecordBatch, width: int, books: np.ndarray):
    """Per block: its row, and per position the tree order, the tree and the entries."""
    for i in range(batch.num_rows):
        tree = np.frombuffer(batch.column("tree")[i].as_py(), np.int32).reshape(PARTS, -1)
        parts = np.frombuffer(batch.column("parts")[i].as_py(), np.int64).reshape(PARTS, tree.shape[1], width)
        kind = exact_kind(parts.reshape(-1, width), books.reshape(-1, width))
        yield i, [(tree[p], Tree(parts[p].astype(kind), _levels(tree.shape[1])), books[p].astype(kind)) for p in range(PARTS)]


def _sums(batches, width: int, books: np.ndarray):
    """Rows of (cell, total, n): what a block adds to each component of each entry that it uses."""
    names = ["cell", "total", "n"]
    for batch in batches:
        for _, positions in _blocks(batch, width, books):
            for p, (_, tree, entries) in enumerate(positions):
                sums, counts = assign(tree, entries)
                used = np.flatnonzero(counts)
                cell = ((p * ENTRIES + used)[:, None] * width + np.arange(width)[None]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(sums[used].ravel().astype(np.int64)),
                                                  pa.array(np.repeat(counts[used], width))], names=names)


def _codes(batches, width: int, books: np.ndarray):
    """Rows of (vec_id, label, code, error)."""
    for batch in batches:
        for i, positions in _blocks(batch, width, books):
            n = len(positions[0][0])
            digits, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, object)
            for p, (order, tree, entries) in enumerate(positions):
                own = np.zeros(n, np.int64)
                assign(tree, entries, own)
                gap = tree.points - entries[own]
                digits[order, p] = own
                error[order] += (gap * gap).sum(axis=1)
            code = digits.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array([code[j * 2 * PARTS:(j + 1) * 2 * PARTS] for j in range(n)], pa.string()),
                 pa.array([min(int(x), MOST) for x in error], pa.int64())], names=["vec_id", "label", "code", "error"])


def lloyd_round(blocks: DataFrame, width: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of the mean of each entry's parts; an unused entry stays."""
    per_block = blocks.mapInArrow(lambda b: _sums(b, width, books), "cell int, total long, n long")
    cells = per_block.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    flat = books.ravel().copy()
    for r in cells:  # entries x dimension of them
        flat[r["cell"] // (ENTRIES * width) * books.shape[1] * width + r["cell"] % (ENTRIES * width)] = int(r["total"]) // r["n"]
    return flat.reshape(books.shape)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors summed over the rows with an equal label (nulls are equal). A label with many
    rows is joined by broadcast, so its rows stay where they are."""
    sums = materialise(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_rows")), "label-errors")
    total = sums.agg(F.sum("_rows")).first()[0] or 0
    hot = sums.where(F.col("_rows") * HOT_SHARE > total)
    out = rows
    found = []
    for name, part, hint in (("_a", hot, F.broadcast), ("_b", sums.where(F.col("_rows") * HOT_SHARE <= total), lambda x: x)):
        side = part.select(F.col("label").alias(f"{name}_label"), F.col("_sum").alias(f"{name}_sum"))
        on = out["label"].eqNullSafe(F.col(f"{name}_label"))
        if name == "_b":  # rows of hot labels have their sum; dealt by id, they meet nothing
            key = F.when(F.col("_a_sum").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("vec_id", "code"))
            out, side = out.withColumn("_key", key), side.withColumn("_side_key", F.xxhash64("_b_label"))
            on = (F.col("_key") == F.col("_side_key")) & F.col("_a_sum").isNull() & F.col("label").eqNullSafe(F.col("_b_label"))
        out = out.join(hint(side), on, "left")
        found.append(F.col(f"{name}_sum"))
    return out.withColumn("label_error", F.least(F.coalesce(*found), F.lit(MOST).cast("decimal(38,0)")).cast("long"))


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                     rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector whose components are all finite numbers.

    The codebooks start as the parts of the 16 smallest ids (ascending, null ids last, equal ids by their
    vectors); with fewer vectors there are fewer entries. Vectors of different length are cut by the longest; a
    shorter one, or a length that the number of parts does not divide, is filled up with zeros. Scaled
    components are held within 2^40, errors within a long. Repeated rows and rows without an id or
    label are coded like any others; null labels count as equal. No vectors: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(
        usable(F.col("v"))).select("vec_id", "label", scaled(F.col("v")).alias("v"))
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kept.schema["label"].dataType),
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    first = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    size = kept.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return spark.createDataFrame([], out).withColumn("label_error", F.lit(0).cast("long")).withColumn("codebooks_sha256", F.lit(""))
    width = max(1, -(-size // PARTS))
    books = np.zeros((len(first), PARTS * width), np.int64)
    for i, v in enumerate(first):
        books[i, :len(v)] = v
    books = books.reshape(len(first), PARTS, width).transpose(1, 0, 2)
    kinds = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)),
                          T.StructField("tree", T.BinaryType()), T.StructField("parts", T.BinaryType())])
    blocks = materialise(kept.mapInArrow(lambda b: _trees(b, width), kinds), "vector-blocks")
    for _ in range(rounds):
        books = lloyd_round(blocks, width, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialise(blocks.mapInArrow(lambda b: _codes(b, width, books), out), "vector-codes")
    return with_label_error(coded).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by plain assignment, one CTE per round."""
    steps = [f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) AS g(p)
), s AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM k
), b0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM p JOIN s USING (rid) WHERE e < {ENTRIES}
)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, p, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m FROM p JOIN b{i} USING (p) GROUP BY rid, p
)""")
        if i < ROUNDS:
            steps.append(f"""u{i} AS (
  SELECT p, e, list(t // n - (CASE WHEN t % n < 0 THEN 1 ELSE 0 END) ORDER BY j) AS c FROM (
    SELECT p, m.e AS e, j, sum(x[j])::HUGEINT AS t, count(*) AS n FROM a{i} JOIN p USING (rid, p), range(1, len(x) + 1) AS g(j) GROUP BY ALL) GROUP BY p, e
), b{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(u{i}.c, b{i}.c)::BIGINT[] AS c FROM b{i} LEFT JOIN u{i} USING (p, e)
)""")
    return "WITH " + ", ".join(steps) + f""", r AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} JOIN k USING (rid) GROUP BY rid, vec_id, label
)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM r
"""


ORACLE_SQL = _oracle()
