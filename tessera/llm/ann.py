"""Operator 9: approximate nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are scaled to length one and rotated by a seeded random orthogonal matrix, so that
every block of columns is a fair sample of a vector's energy. Lists come from k-means on a
bounded sample (``sample_rows``); every vector is put into its nearest list, and a query
scans its nearest lists, as many as exact searches in the sample need for ``target_recall``. A scan walks the columns block by block: after d of D columns the
partial squared distance, scaled by D / d, estimates the whole, and a candidate is abandoned
when the estimate exceeds the query's current k-th distance by more than the error bound
``(1 + EPSILON / sqrt(d)) ** 2`` of the hypothesis test. What survives is scored exactly, in
double precision, on the original vectors.

Equal vectors are searched once: only the k + 1 smallest ids of a vector can be among the k
nearest of any query, ties going to the smaller id. Large lists are dealt in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import materialise, parallelism, prepare

K = 5
QUERY_STEP = 50
LIST_ROWS = 1000
MAX_LISTS = 4096
SAMPLE_ROWS = 20_000
TARGET_RECALL = 0.98
TEST_QUERIES = 400
BLOCK_ROWS = 4096
QUERY_ROWS = 256
COLUMNS = 16
EPSILON = 2.1
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_lists(x, centre, 1)[:, 0]
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centre[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centre


def nearest_lists(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    size = (centre * centre).sum(axis=1)
    for i in range(0, len(x), 2048):
        d = size - 2 * (x[i:i + 2048] @ centre.T)
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centre) else np.tile(np.arange(len(centre)), (len(d), 1))
        out[i:i + 2048] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)
    return out


def probes_for(x: np.ndarray, centre: np.ndarray, k: int, target: float, seed: int = SEED) -> int:
    """How many lists a query must scan to find the share ``target`` of its k nearest, by exact search in the sample ``x``."""
    if len(centre) < 2:
        return 1
    rows = np.random.default_rng(seed).choice(len(x), min(TEST_QUERIES, len(x)), replace=False)
    own = nearest_lists(x, centre, 1)[:, 0]
    order = nearest_lists(x[rows], centre, len(centre))
    near = x[rows] @ x.T
    near[np.arange(len(rows)), rows] = -np.inf
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    place = (order[:, None, :] == own[best][:, :, None]).argmax(axis=2)  # how near the neighbour's list is to the query
    return int(np.quantile(place, target, method="higher")) + 1


def adaptive_scan(q: np.ndarray, c: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that may be among the k nearest of the query; rotated unit vectors."""
    dim = q.shape[1]
    first = min(len(c), max(64, 4 * k))
    head = ((q[:, None, :] - c[None, :first, :]) ** 2).sum(axis=2) if len(q) * first * dim < 1 << 24 else 2 - 2 * (q @ c[:first].T)
    if len(c) <= first:
        i, j = np.nonzero(head <= np.partition(head, min(k, first) - 1, axis=1)[:, [min(k, first) - 1]] + 1e-5)
        return i, j
    limit = np.partition(head, k - 1, axis=1)[:, k - 1]
    i = j = partial = None
    for at in range(0, dim, columns):
        end = min(dim, at + columns)
        qb, cb = q[:, at:end], c[:, at:end]
        if i is None:
            d = (qb * qb).sum(axis=1)[:, None] + (cb * cb).sum(axis=1)[None, :] - 2 * (qb @ cb.T)
            i, j = np.nonzero(d * (dim / end) <= (limit * (1 + epsilon / np.sqrt(end)) ** 2)[:, None])
            partial = d[i, j]
            continue
        partial = partial + ((qb[i] - cb[j]) ** 2).sum(axis=1)
        bound = limit[i] + 1e-5 if end == dim else limit[i] * (1 + epsilon / np.sqrt(end)) ** 2 * (end / dim)
        live = partial <= bound
        i, j, partial = i[live], j[live], partial[live]
    by = np.lexsort((partial, i))  # the k nearest of each query and what ties with the last of them
    i, j, partial = i[by], j[by], partial[by]
    new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    n = np.diff(np.r_[new, len(i)])
    last = np.repeat(partial[new + np.minimum(n, k) - 1], n)
    live = partial <= last + 1e-5
    return i[live], j[live]


def _scan_task(dim: int, k: int, seed: int):
    turn = rotation(dim, seed).astype(np.float32)

    def run(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cands) and len(queries):
            cands = cands.sort_values(["first_id", "rep_id"])  # ties go to the smaller id
            c64 = np.stack(cands["embedding"].to_numpy()).astype(np.float64)
            cu = unit(c64)
            cr = cu.astype(np.float32) @ turn
            cn = np.linalg.norm(c64, axis=1)
            ids, firsts = cands["rep_id"].to_numpy(), cands["first_id"].to_numpy()
            for a in range(0, len(queries), QUERY_ROWS):
                part = queries.iloc[a:a + QUERY_ROWS]
                q64 = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                i, j = adaptive_scan(unit(q64).astype(np.float32) @ turn, cr, k)
                score = np.einsum("nd,nd->n", q64[i], c64[j]) / (np.linalg.norm(q64, axis=1)[i] * cn[j])
                out.append(pd.DataFrame({"q_rep": part["rep_id"].to_numpy()[i], "rep_id": ids[j], "first_id": firsts[j], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q_rep": pd.Series(dtype="int64"), "rep_id": pd.Series(dtype="int64"), "first_id": pd.Series(dtype="int64"),
                                                        "score": pd.Series(dtype="float64")})

    return run


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, embedding``: the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), x.alias("embedding"))


def nearest_neighbours(df: DataFrame, queries: Column | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
                       target_recall: float = TARGET_RECALL, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k nearest rows by cosine, itself excluded.

    ``queries`` picks the query rows (by ``vec_id``; by default the ids divisible by 50). Null
    ids, and vectors that are null, empty, all zero or hold a null or non-finite component,
    take no part; nor do vectors of another length than the most common one. Rows that share an
    id, or repeat a row, are candidates each; a query row that repeats another is answered once, and its own
    row is left out once. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark, 2000)
    valid = valid_vectors(df, id_col, vector_col)
    sizes = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["dim"]
    valid = materialise(valid.where(F.size("embedding") == dim), "vectors")
    # of each vector the k + 1 smallest ids; the limit per group applies before the shuffle as well
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    reps = materialise(valid.withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("embedding").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("rep_id"), F.col("ids")[0].alias("first_id"), "ids", "embedding"), "distinct")

    total = reps.count()
    n_lists = max(1, min(MAX_LISTS, total // list_rows))
    share = min(1.0, sample_rows / total)
    sample = reps.where(F.pmod(F.xxhash64("rep_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").toArrow()
    x = unit(np.stack(sample["embedding"].to_numpy())) if len(sample) else np.zeros((0, dim))
    n_lists = min(n_lists, max(1, len(x) // 8))
    centres = kmeans(x, n_lists, seed=seed) if n_lists > 1 else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centres)
    n_probes = probes_for(x, centres, k, target_recall, seed)

    @F.pandas_udf("array<int>")
    def lists_of(vectors: pd.Series, n: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(nearest_lists(unit(np.stack(vectors.to_numpy())), shared.value, int(n.iloc[0])).astype(np.int32)))

    placed = materialise(reps.withColumn("list", lists_of("embedding", F.lit(1))[0]), "lists")
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))  # at most MAX_LISTS rows
    cands = placed.join(F.broadcast(blocks), "list").select(
        "list", F.pmod(F.xxhash64("rep_id"), F.col("blocks")).cast("int").alias("block"), "rep_id", "first_id", "embedding")

    wanted = (F.col("vec_id") % QUERY_STEP == 0) if queries is None else queries
    asked = materialise(valid.where(wanted).join(reps.select("embedding", "rep_id"), "embedding").select(
        F.col("vec_id").alias("query_id"), F.col("rep_id").alias("q_rep")).distinct(), "queries")
    probing = (reps.join(asked.select(F.col("q_rep").alias("rep_id")).distinct(), "rep_id")
               .select("rep_id", "embedding", F.explode(lists_of("embedding", F.lit(n_probes))).alias("list"))
               .join(F.broadcast(blocks), "list")
               .select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep_id", "embedding"))
    n = parallelism(spark)
    found = (cands.repartition(n, "list", "block").groupBy("list", "block")
             .cogroup(probing.repartition(n, "list", "block").groupBy("list", "block"))
             .applyInPandas(_scan_task(dim, k + 1, seed), "q_rep long, rep_id long, first_id long, score double"))
    best = F.row_number().over(Window.partitionBy("q_rep").orderBy(F.desc("score"), "first_id", "rep_id"))
    found = found.withColumn("_n", best).where(F.col("_n") <= k + 1).drop("_n")
    first = F.transform("ids", lambda x, i: F.struct(x.alias("vec_id"), ((i == 0) | (F.get(F.col("ids"), i - 1) != x)).alias("first")))
    pairs = found.join(reps.select("rep_id", first.alias("ids")), "rep_id").select("q_rep", "score", "rep_id", F.inline("ids"))
    best = F.row_number().over(Window.partitionBy("q_rep").orderBy(F.desc("score"), "vec_id"))
    pairs = pairs.withColumn("_n", best).where(F.col("_n") <= k + 1).drop("_n")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_rep").orderBy(F.desc("score"), "vec_id"))
    own = (F.col("rep_id") == F.col("q_rep")) & (F.col("vec_id") == F.col("query_id")) & F.col("first")
    return (asked.join(pairs, "q_rep").where(~own).withColumn("rank", rank)
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
