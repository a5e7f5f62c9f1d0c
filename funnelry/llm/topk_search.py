"""Exact top-k by inner product, in norm order with rotated partial sums.

Queries and candidates are dealt by hash into blocks, and each pair of blocks is
one group: it goes through its candidates by descending length, a tile at a time.
A query stops when even the longest vector left cannot reach its k-th score. For
the rest of the tile, the products of the first coordinates, after a rotation to
the principal axes (from the SVD of a sample), plus the Cauchy-Schwarz bound of
the residuals tell which candidates can; those are scored in integers.
The block results of a query are merged by a grouped limit.

Scores are of floor(scale * x), x as double. The rotation is fitted on
``ROTATION_ROWS`` vectors and only decides how much is pruned.

Defined cases: vectors that are null or hold null or non-finite components (as they are or scaled), and rows
without an id, take no part; integers beyond a long's range, components and scores, wrap around, and
where scores could, nothing is pruned; a vector shorter than the longest is filled with zeros; ties go to the smaller id;
candidates with the query's own id are left out; repeated query rows give one
result, and of one id with several vectors each vector's; repeated candidate rows
are candidates each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import small_batches

SCALE, K = 1024, 10
ROTATION_ROWS = 4096
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 8192, 16_384, 512


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of integers, short ones filled with zeros."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]  # falls as scores rise, for the least long too


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                 rotation: np.ndarray, k: int, tile: int = TILE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best among the vectors, all in integers."""
    n, width = queries.shape
    length = np.linalg.norm(vectors.astype(float), axis=1)
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    front = max(1, width // 4)
    q, x = queries.astype(float), vectors.astype(float)
    q_turned, x_turned = q @ rotation, x @ rotation
    q_length = np.linalg.norm(q, axis=1)
    q_rest, x_rest = (np.linalg.norm(m[:, front:], axis=1) for m in (q_turned, x_turned))
    # integers below 2^53 are exact as doubles, and so are their sums
    exact = width * float(abs(q).max(initial=0)) * float(abs(x).max(initial=0)) < 2 ** 53
    wraps = width * float(abs(q).max(initial=0)) * float(abs(x).max(initial=0)) >= 2.0 ** 62
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]
    least = np.full(n, -np.inf)
    active = np.arange(n)
    for at in range(0, len(ids), tile):
        slack = 1e-9 * q_length * length[at] + 1e-6
        active = active[q_length[active] * length[at] + slack[active] >= least[active]]
        if not len(active):
            break
        part = slice(at, at + tile)
        bound = q_turned[active][:, :front] @ x_turned[part][:, :front].T + np.outer(q_rest[active], x_rest[part])
        open_ = (bound + slack[active][:, None] >= least[active][:, None]) & (query_ids[active][:, None] != ids[part])
        rows, columns = np.nonzero(open_)
        left, right = active[rows], columns + at
        scores = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 1 << 16):
            a, b = left[i:i + (1 << 16)], right[i:i + (1 << 16)]
            scores[i:i + (1 << 16)] = np.einsum("ij,ij->i", q[a], x[b]) if exact else (queries[a] * vectors[b]).sum(axis=1)
        cuts = np.searchsorted(rows, np.arange(len(active) + 1))
        for i, query in enumerate(active):
            if cuts[i] == cuts[i + 1]:
                continue
            own = slice(cuts[i], cuts[i + 1])
            known = np.concatenate([best[query][0], ids[right[own]]]), np.concatenate([best[query][1], scores[own]])
            top = _merge(*known, k)
            best[query] = known[0][top], known[1][top]
            if len(top) == k and not wraps:
                least[query] = best[query][1][-1]
    return best


def _valid(vector: Column) -> Column:
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fits), F.lit(False))


def _whole(x: Column) -> Column:
    """floor(x) as a long; what is beyond its range, an integer already, wraps around."""
    low = F.pmod(x, F.lit(2.0 ** 64))
    wrapped = F.when(low >= 2.0 ** 63, low - 2.0 ** 64).otherwise(low)
    return F.when(F.abs(x) < 2.0 ** 62, F.floor(F.when(F.abs(x) < 2.0 ** 62, x))).otherwise(wrapped.cast("long"))


def _rotation(rows: DataFrame, width: int, sample: int) -> np.ndarray:
    chosen = rows.select("id", "vector").orderBy(F.xxhash64("id", "vector")).limit(sample).select("vector")
    matrix = _matrix(pa.chunked_array([chosen.toArrow().column("vector").combine_chunks()]), width).astype(float)
    _, _, axes = np.linalg.svd(matrix, full_matrices=True) if len(matrix) else (0, 0, np.eye(width))
    return axes.T


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
          scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
          rotation_rows: int = ROTATION_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows for every row that ``is_query`` marks."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("raw"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.transform("raw", lambda x: x.cast("double") * scale)))
    rows = rows.select("id", "asks", F.transform("raw", lambda x: _whole(x.cast("double") * scale)).alias("vector"))
    shape = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asked"),
                     F.max(F.size("vector")).alias("width")).first()
    across, down = max(1, -(-shape.asked // query_block)), max(1, -(-shape.n // candidate_block))
    width = shape.width or 1
    rotation = _rotation(rows, width, rotation_rows)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").select("id", "vector").distinct() \
        .withColumn("across", F.pmod(F.xxhash64("id", "vector"), F.lit(across)).cast("int")) \
        .withColumn("down", every(down))
    candidates = rows.select("id", "vector", F.pmod(F.xxhash64("vector", "id"), F.lit(down)).cast("int").alias("down")) \
        .withColumn("across", every(across))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids = left.column("id").to_numpy()
        asked = _matrix(left.column("vector"), width)
        found = []
        if len(query_ids) and right.num_rows:
            found = search_block(query_ids, asked, right.column("id").to_numpy(), _matrix(right.column("vector"), width),
                                 rotation, k)
        size = [len(ids) for ids, _ in found]
        which = np.repeat(np.arange(len(found)), size)
        none = [np.zeros(0, np.int64)]
        return pa.table({
            "query_id": pa.array(query_ids[which] if len(found) else none[0], pa.int64()),
            "version": left.column("version").combine_chunks().take(pa.array(which, pa.int64())) if len(found) else pa.array([], pa.int64()),
            "vec_id": pa.array(np.concatenate(none + [ids for ids, _ in found])),
            "score": pa.array(np.concatenate(none + [scores for _, scores in found]))})

    queries = queries.withColumn("version", F.xxhash64("vector"))
    found = queries.groupBy("across", "down").cogroup(candidates.groupBy("across", "down")).applyInArrow(
        search, "query_id long, version long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
