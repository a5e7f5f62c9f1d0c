"""Approximate nearest neighbours by an adaptive scan of the dimensions of probed lists.

A random rotation spreads the length of any difference evenly over the dimensions,
so the first d of D rotated dimensions estimate a distance. Vectors lie in lists
around centroids; a query probes the lists with the nearest ones. A list is scanned by
blocks of columns: after each block a candidate is abandoned if the hypothesis that it
is nearer than the query's k-th so far is rejected, that is if its partial squared
distance exceeds d / D * (1 + epsilon / sqrt(d))^2 of the k-th's. What is left after the
last block is measured on the original vectors, in double precision.

The nearest list comes first, and the k-th distance found in it is where the other
probed lists start. Equal vectors are one candidate with its k + 1 smallest ids (no
result can hold more of them), so large groups of copies cost nothing, and equal
queries are searched once. Lists and their queries are dealt into parts of bounded size.

The rotation is fixed by a seed; the centroids are fitted on the ``SAMPLE`` distinct vectors with
the smallest hashes; all rows are indexed. How many lists a query probes is found on that sample too: as
many as hold the share ``target`` of the true neighbours of ``TRIALS`` of its vectors. Neighbours in a sample are
farther than those in the table, so that is rather too many. The tests measure recall against brute force.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and
rows without an id, take no part; a vector shorter than the longest is filled with
zeros, and one without components is zero; a query's own row is left out; a row that is repeated with
one id counts once, rows of one id with different vectors count each; ties go to the smaller id; a distance
beyond the range of doubles is infinite and comes last; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import record_batch, small_batches, stored

K = 10
#: Vectors that the centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 16_384, 8
#: Share of the nearest neighbours that the probed lists should hold, and the sampled queries that tell how many lists that takes.
TARGET, TRIALS = 0.98, 512
#: Rotated dimensions of a column block, and the strictness of the hypothesis test.
COLUMNS, EPSILON = 16, 2.1
#: Rows and queries of one part of a list, and candidates scanned at a time.
PART, QUERIES, TILE = 16_384, 2048, 2048
_SEED = 20_240


def rotation_of(width: int) -> np.ndarray:
    turned, upper = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((width, width)))
    return turned * np.sign(np.diag(upper))


def matrix_of(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of a and b, dimension after dimension, so that equal pairs give equal bits."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for x, y in zip(a.T, b.T):
            total += (x - y) ** 2
    return total


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a sample, by k-means from rows of it."""
    centroids = sample[np.random.default_rng(_SEED).permutation(len(sample))[:lists]]
    for _ in range(rounds):
        own = nearest_lists(sample, centroids, 1)[:, 0]
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest_lists(vectors: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centroids of each vector, nearest first."""
    out = np.empty((len(vectors), probes), np.int64)
    lengths = (centroids ** 2).sum(axis=1)
    for at in range(0, len(vectors), 4096):
        far = lengths - 2 * vectors[at:at + 4096] @ centroids.T
        some = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.tile(np.arange(probes), (len(far), 1))
        some.sort(axis=1)
        out[at:at + 4096] = np.take_along_axis(some, np.take_along_axis(far, some, axis=1).argsort(axis=1, kind="stable"), axis=1)
    return out


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, trials: int = TRIALS) -> int:
    """How many of the nearest lists hold the share ``target`` of the k nearest sampled vectors of a sampled vector."""
    asked = sample[:trials]
    far = (sample ** 2).sum(axis=1) - 2 * asked @ sample.T
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1 or target >= 1:
        return len(centroids)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    order = nearest_lists(asked, centroids, len(centroids)).argsort(axis=1)
    places = np.take_along_axis(order, nearest_lists(sample, centroids, 1)[:, 0][near], axis=1)
    return int(np.quantile(places, target, method="higher")) + 1


def scan_list(query: np.ndarray, turned_query: np.ndarray, least: float, vectors: np.ndarray, turned: list[np.ndarray],
              ids: np.ndarray, k: int, epsilon: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the k nearest rows found, ties to the smaller id. ``turned``: the
    rotated vectors in column blocks; ``least``: a squared distance that a row of the result needn't exceed."""
    width = vectors.shape[1]
    best, far = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(vectors), tile):
        left = np.arange(at, min(at + tile, len(vectors)))
        partial, done = np.zeros(len(left)), 0
        for block in turned:
            partial = partial + ((block[left] - turned_query[done:done + block.shape[1]]) ** 2).sum(axis=1)
            done += block.shape[1]
            strict = (1 + epsilon / math.sqrt(done)) ** 2 * done / width if done < width else 1 + 1e-9
            stay = ~(partial > least * strict)
            left, partial = left[stay], partial[stay]
        if not len(left):
            continue
        exact = squares(vectors[left], np.broadcast_to(query, (len(left), width)))
        best, far = np.concatenate([best, left]), np.concatenate([far, exact])
        top = np.lexsort((ids[best], far))[:k]
        best, far = best[top], far[top]
        if len(top) == k:
            least = min(least, far[-1])
    return best, far


_FOUND = pa.schema([("query", pa.int64()), ("version", pa.int64()), ("row", pa.int64()), ("row_version", pa.int64()),
                    ("square", pa.float64())])


def _valid(vector: Column) -> Column:
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fits), F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _sample(classes: DataFrame, width: int, rows: int) -> np.ndarray:
    chosen = classes.select("row", "row_version", "vector").orderBy(F.xxhash64("row", "row_version"), "row").limit(rows)
    return matrix_of(chosen.select("vector").toArrow().column("vector"), width)


def _assigned(rows: DataFrame, centroids: np.ndarray, probes: int, keys: list[str]) -> DataFrame:
    """Each row with its ``probes`` nearest lists, nearest first: columns list and place."""
    width = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, "vector").schema)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                lists = nearest_lists(matrix_of(batch.column("vector"), width), shared.value, probes)
                cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(lists.ravel()))],
                                                 names=[*batch.schema.names, "lists"])

    found = rows.select(*keys, "vector").mapInArrow(assign, f"{kind}, lists array<long>")
    return found.select(*keys, "vector", F.posexplode("lists").alias("place", "list"))


def _searched(asked: DataFrame, index: DataFrame, parts: dict[int, int], width: int, k: int, columns: int, epsilon: float) -> DataFrame:
    """The nearest rows of each part of a list for the queries that probe it; ``asked`` has the column least."""
    counts = {r["list"]: max(1, -(-r["count"] // QUERIES)) for r in asked.groupBy("list").count().toLocalIterator()}
    dealt = lambda times: F.element_at(F.create_map(*[F.lit(x) for i, n in sorted(times.items()) for x in (i, n)]), F.col("list")) \
        if times else F.lit(1)
    every = lambda times: F.explode(F.sequence(F.lit(0), F.coalesce(dealt(times), F.lit(1)) - 1))
    one = lambda times, *by: F.pmod(F.xxhash64(*by), F.coalesce(dealt(times), F.lit(1))).cast("int")
    left = asked.withColumn("part", every(parts)).withColumn("across", one(counts, "query", "version"))
    right = index.withColumn("part", one(parts, "row", "row_version")).withColumn("across", every(counts))
    turn = rotation_of(width)

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            vectors, asking = matrix_of(rows.column("vector"), width), matrix_of(queries.column("vector"), width)
            ids, versions = (rows.column(c).to_numpy() for c in ("row", "row_version"))
            turned, turned_queries = vectors @ turn, asking @ turn
            blocks = [np.ascontiguousarray(turned[:, a:a + columns]) for a in range(0, width, columns)]
            for i, (query, version, least) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("query", "version", "least")))):
                best, far = scan_list(asking[i], turned_queries[i], least, vectors, blocks, ids, k, epsilon)
                out.append(record_batch(_FOUND, np.full(len(best), query), np.full(len(best), version), ids[best], versions[best], far))
        return pa.Table.from_batches(out, _FOUND)

    return left.groupBy("list", "part", "across").cogroup(right.groupBy("list", "part", "across")).applyInArrow(
        search, "query long, version long, row long, row_version long, square double")


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
            target: float = TARGET, sample: int = SAMPLE, columns: int = COLUMNS, epsilon: float = EPSILON,
            part: int = PART) -> DataFrame:
    """query_id, rank (from 1), ``key``, score: the ``k`` nearest rows found, by Euclidean distance, for
    every row that ``is_query`` marks."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & _valid(F.col("vector")))
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        none = "query_id long, rank int, `{}` long, score double".format(key)
        return vectors.sparkSession.createDataFrame([], none)
    # fill with zeros first, so that vectors that are equal then are one; -0.0 becomes 0.0
    filled = F.transform(F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))), lambda x: x + 0.0)
    rows = rows.select("id", "asks", filled.alias("vector")).withColumn("hash", F.xxhash64("vector")) \
        .groupBy("hash", "vector", "id").agg(F.max("asks").alias("asks"))
    rows = stored(rows, "vectors")
    place = F.row_number().over(Window.partitionBy("hash", "vector").orderBy("id"))
    first = rows.withColumn("at", place).where(F.col("at") <= k + 1)
    classes = stored(first.groupBy("hash", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("row"), F.col("hash").alias("row_version"), "vector", "ids"), "vector-classes")
    # at least 16 sampled vectors to a list, and about as many lists as vectors in one
    n = classes.count()
    lists = max(1, min(sample // 16, n // 16, math.isqrt(n)))
    seen = _sample(classes, width, sample)
    centroids = fit_centroids(seen, lists)
    probes = probes_for(seen, centroids, k, target)
    index = stored(_assigned(classes, centroids, 1, ["row", "row_version"]).drop("place"), "vector-lists")
    parts = {r["list"]: max(1, -(-r["count"] // part)) for r in index.groupBy("list").count().toLocalIterator()}

    asking = rows.where("asks").select("id", "hash", "vector")
    own = asking.join(classes.select("row", F.col("row_version").alias("hash"), "vector"), ["hash", "vector"]) \
        .select("id", F.col("row").alias("query"), F.col("hash").alias("version"))
    own = stored(own, "query-classes")
    wanted = own.select(F.col("query").alias("row"), F.col("version").alias("row_version")).distinct()
    queries = classes.join(wanted, ["row", "row_version"], "left_semi").select(
        F.col("row").alias("query"), F.col("row_version").alias("version"), "vector")
    probed = stored(_assigned(queries, centroids, probes, ["query", "version"]), "probes")
    told = (index, parts, width, k + 1, columns, epsilon)
    near = stored(_searched(probed.where("place = 0").withColumn("least", F.lit(float("inf"))), *told), "nearest-list")
    bound = near.withColumn("at", F.row_number().over(Window.partitionBy("query", "version").orderBy("square", "row"))) \
        .where(F.col("at") == k + 1).select("query", "version", F.col("square").alias("least"))
    rest = probed.where("place > 0").join(bound, ["query", "version"], "left").withColumn("least", F.coalesce("least", F.lit(float("inf"))))
    best = near.unionByName(_searched(rest, *told)).withColumn(
        "at", F.row_number().over(Window.partitionBy("query", "version").orderBy("square", "row", "row_version"))).where(F.col("at") <= k + 1)
    copies = best.join(classes.select("row", "row_version", "ids"), ["row", "row_version"]).select(
        "query", "version", "square", "row_version", F.explode("ids").alias("vec"))
    order = Window.partitionBy("query", "version").orderBy("square", "vec", "row_version")
    top = copies.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at")
    # each query of a class gets the class' list without its own row
    each = own.withColumn("key", F.xxhash64("query", "version")).join(
        top.withColumn("key", F.xxhash64("query", "version")), ["key", "query", "version"]).where(
        (F.col("vec") != F.col("id")) | (F.col("row_version") != F.col("version")))
    final = F.row_number().over(Window.partitionBy("id", "version").orderBy("square", "vec", "row_version"))
    return each.withColumn("rank", final).where(F.col("rank") <= k).select(
        F.col("id").alias("query_id"), "rank", F.col("vec").alias(key), F.sqrt("square").alias("score"))
