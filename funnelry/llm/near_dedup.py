"""MinHash near-dedup by fast similarity sketching.

A document is the set of its word shingles. Its sketch has one value in each of
``BANDS * ROWS`` bins: in round i each shingle is placed in one hashed bin with
value (i, hash), and a bin keeps its smallest; from round ``bins`` on, round
bins + b puts all shingles in bin b. So every bin fills, and agreement
concentrates around the similarity as with sampling without replacement.
Documents that agree on all rows of a band are candidates, and links are
confirmed on the full sets.

At similarity 0.8 a pair misses all 38 bands of 5 rows with probability 3e-7, at 0.85 with 2e-10.

No bucket is expanded into pairs. Equal sets are one class first. Then each
class of a bucket is compared with the bucket's smallest one, and the links
that hold give components. Of the classes whose bucket then still holds several
components, those in different components meet by an exact prefix and position
filter over their rarest shingles and are confirmed too, so no link between
components is lost.

Defined cases: null and empty texts have no shingles and no links; fewer words
than ``words`` are one shingle; a null doc_id is the largest (a component of such
alone has a null id); rows of one id are told apart by their text's hash, and
repeated rows of one id and text are one document with one result; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .graph import components
from .tasks import record_batch, small_batches, stored

WORDS, PERCENT = 5, 80
BANDS, ROWS = 38, 5
BINS = BANDS * ROWS
_LAST_ID = (1 << 63) - 1
U64 = np.uint64
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ROUND_SEEDS = rolling.mix(np.arange(1, 2 * BINS + 1, dtype=U64) * rolling.SECOND_BASE)
_ROW_SEEDS = rolling.mix(np.arange(1, BINS + 1, dtype=U64) * rolling.WINDOW_BASE).reshape(BANDS, ROWS) | U64(1)
_EMPTY = U64((1 << 64) - 1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    data, bounds = rolling.utf8_bytes(texts)
    starts, ends, own = rolling.word_spans(data, bounds)
    units = rolling.span_hashes(_LOWER[data], starts, ends)
    grams = rolling.mix(rolling.gram_hashes(units, words, rolling.GRAM_BASE))
    sets = []
    for a, b in zip(own[:-1], own[1:]):
        if b - a >= words:
            sets.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            sets.append(rolling.hash_at(units, np.array([a]), int(b - a), rolling.SECOND_BASE))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The bins' values for a set that isn't empty."""
    bins = np.full(BINS, _EMPTY)
    many = max(1, BINS // len(shingles))  # rounds at a time, so that small sets don't take long
    for first in range(0, BINS, many):
        rounds = np.arange(first, min(BINS, first + many))
        placed = rolling.mix(shingles[None, :] ^ _ROUND_SEEDS[rounds][:, None])
        value = (rolling.mix(placed) >> U64(12)) | (rounds.astype(U64)[:, None] << U64(52))
        np.minimum.at(bins, ((placed >> U64(32)) % U64(BINS)).astype(np.intp).ravel(), value.ravel())
        if (bins != _EMPTY).all():
            return bins
    for b in np.flatnonzero(bins == _EMPTY):
        value = rolling.mix(rolling.mix(shingles ^ _ROUND_SEEDS[BINS + b]))
        bins[b] = (value.min() >> U64(12)) | U64((BINS + int(b)) << 52)
    return bins


def band_hashes(bins: np.ndarray) -> np.ndarray:
    return rolling.mix((rolling.mix(bins.reshape(BANDS, ROWS)) * _ROW_SEEDS).sum(axis=1, dtype=U64))


_SIGNED = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()),
                     ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signatures(rows: DataFrame, words: int) -> DataFrame:
    """Per document: n (size of its set), a 128-bit hash of the set, and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.text_slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                a = [s.sum(dtype=U64) for s in sets]
                b = [rolling.mix(s ^ rolling.SECOND_BASE).sum(dtype=U64) for s in sets]
                bands = [rolling.signed(band_hashes(sketch(s))) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield record_batch(
                    _SIGNED, part.column("id"), part.column("version"), [len(s) for s in sets],
                    rolling.signed(np.array(a, U64)), rolling.signed(np.array(b, U64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands))))

    return rows.mapInArrow(run, "id long, version long, n long, set_a long, set_b long, bands array<long>")


def _close_in_size(percent: int):
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    first = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    second = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    rows = pairs.select("u", "v").join(first, "u").join(second, "v").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.text_slices(batch, "text_u", 1 << 20):
                left = shingle_sets(part.column("text_u"), words)
                # neighbours often share the second text
                right, known = [], (None, None)
                for text in part.column("text_v"):
                    if known[0] != text:
                        known = (text, shingle_sets(pa.array([text.as_py()], pa.string()), words)[0])
                    right.append(known[1])
                holds = []
                for a, b in zip(left, right):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    holds.append(100 * common >= percent * (len(a) + len(b) - common))
                yield part.select(["u", "v"]).filter(pa.array(holds))

    kind = "struct<id:bigint,version:bigint>"
    return rows.mapInArrow(run, f"u {kind}, v {kind}")


def cross_root_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first`` (shingle, root, ...) beside rows of ``second`` (shingle, other_root, ...), the
    shingle shared; all pairs of different roots are among them, of pairs of one root only few.

    Two members of one root never have to meet. So a shingle of a single root goes, and rows of a
    shingle's most frequent root meet rows of its other roots only. What the others' pairs hold of one root is no more than
    their pairs with the most frequent root, so the work follows the pairs that count.
    """
    roots = first.select("shingle", "root").unionByName(second.select("shingle", F.col("other_root").alias("root"))) \
        .groupBy("shingle", "root").agg(F.count("*").alias("n"))
    most = roots.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")) \
        .where("roots > 1").select(F.xxhash64("shingle").alias("key"), F.col("shingle").alias("s"), F.col("most.root").alias("most"))
    of = lambda rows, root: rows.withColumn("key", F.xxhash64("shingle")).join(most, "key").where("shingle = s") \
        .withColumn("major", F.col(root) == F.col("most")).drop("key", "s", "most")
    wanted = F.when(F.col("major"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    left = of(first, "root").withColumn("other_major", F.explode(wanted)).drop("major")
    return left.join(of(second, "other_root").withColumnRenamed("major", "other_major"), ["shingle", "other_major"])


def _across(members: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of members in different components that can be similar enough.

    Prefix filter: with any one order of all shingles, two sets of similarity p
    and sizes n >= m share one of the first n - ceil(p * n) + 1 of the larger and
    the first m - ceil(2p / (1 + p) * m) + 1 of the smaller, and from the first
    shared one on both have as many left as their overlap needs. Rare shingles
    come first, so a passage that very many members share pairs nobody unless
    it is nearly all they have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.text_slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                cuts = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                shingles = pa.ListArray.from_arrays(cuts, pa.array(rolling.signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays([*part.select(["node", "n", "root"]).columns, shingles],
                                                 names=["node", "n", "root", "shingles"])

    kind = "struct<id:bigint,version:bigint>"
    sets = stored(members.select("node", "n", "root", "text").mapInArrow(
        run, f"node {kind}, n long, root {kind}, shingles array<long>"), "sets")
    rows = sets.select("node", "n", "root", F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").count().where("count > 1") \
        .select(F.xxhash64("shingle").alias("at"), F.col("shingle").alias("s"), F.col("count").alias("times"))
    rows = rows.withColumn("at", F.xxhash64("shingle")).join(common, "at", "left").where("s IS NULL OR s = shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(1)), "shingle"))
    up = lambda part, whole: F.floor((part + whole - 1) / whole)
    first = rows.withColumn("place", place).where(
        F.col("times").isNotNull() & (F.col("place") <= F.col("n") - up(F.col("n") * percent, 100) + 1))
    first = stored(first.select("shingle", "node", "n", "root", "place"), "prefixes")
    small = first.where(F.col("place") <= F.col("n") - up(2 * percent * F.col("n"), 100 + percent) + 1).select(
        "shingle", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"),
        F.col("place").alias("at"))
    needed = up(percent * (F.col("n") + F.col("m")), 100 + percent)
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    return cross_root_pairs(first, small).where(
        (F.col("root") != F.col("other_root")) & (F.col("m") <= F.col("n")) & _close_in_size(percent) & (left >= needed)) \
        .select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: key, version (hash of its text), n_shingles, component_id (the
    smallest key linked with it over any number of links, itself included) and kept
    (whether it is the one document of its component that has that key)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST_ID)).alias("id"),
                       F.xxhash64(text).alias("version"), F.coalesce(text, F.lit("")).alias("text"))
    signed = stored(_signatures(rows, words), "signatures")
    node = F.struct("id", "version")
    classes = stored(signed.where("n > 0").groupBy("set_a", "set_b", "n").agg(
        F.min(node).alias("node"), F.first("bands").alias("bands")), "classes")

    rows_of_bands = classes.select(F.explode("bands").alias("band"), "node", "n")
    pivot = F.min(F.struct("node", "n")).alias("pivot")
    shared = rows_of_bands.groupBy("band").agg(pivot, F.count("*").alias("members")).where("members > 1") \
        .select(F.xxhash64("band").alias("at"), F.col("band").alias("b"), "pivot")
    buckets = stored(rows_of_bands.withColumn("at", F.xxhash64("band")).join(shared, "at").where("band = b")
                     .select("band", "node", "n", "pivot"), "buckets")
    wanted = buckets.select("node.id", "node.version")
    texts = stored(rows.join(wanted, ["id", "version"], "left_semi").select(node.alias("node"), "text"), "texts")

    stars = stored(buckets.select(F.col("node").alias("u"), F.col("pivot.node").alias("v"), "n",
                                  F.col("pivot.n").alias("m"))
                   .where((F.col("u") != F.col("v")) & _close_in_size(percent)).select("u", "v").distinct(), "stars")
    links = stored(_confirmed(stars, texts, words, percent), "links")
    roots = components(links)
    placed = stored(buckets.select("band", "node", "n").join(roots, "node", "left")
                    .withColumn("root", F.coalesce("root", "node")), "placed")
    open_bands = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
        .where("low <> high").select(F.xxhash64("band").alias("at"), F.col("band").alias("b"))
    apart = placed.withColumn("at", F.xxhash64("band")).join(open_bands, "at").where("band = b") \
        .select("node", "n", "root").distinct()
    rest = _across(apart.join(texts, "node"), words, percent)
    more = stored(_confirmed(rest, texts, words, percent), "links")
    if more.limit(1).count():  # few: they join components, so only roots are linked anew
        own = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        joined = more.join(own("u"), "u", "left").join(own("v"), "v", "left").select(
            F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
        anew = components(joined).withColumnRenamed("root", "top")
        moved = roots.join(anew.select(F.col("node").alias("root"), "top"), "root", "left") \
            .select("node", F.coalesce("top", "root").alias("root"))
        roots = moved.unionByName(anew.select("node", F.col("top").alias("root")))

    found = classes.select(F.xxhash64("set_a", "set_b", "n").alias("at"), F.col("set_a").alias("a"),
                           F.col("set_b").alias("b"), F.col("n").alias("size"), "node") \
        .join(roots, "node", "left").select("at", "a", "b", "size", F.coalesce("root", "node").alias("root"))
    own = F.when(F.col("root").isNull(), node).otherwise(F.col("root"))  # empty sets stay alone
    result = signed.drop("bands").withColumn("at", F.xxhash64("set_a", "set_b", "n")) \
        .join(found, "at", "left").where("a IS NULL OR (set_a = a AND set_b = b AND n = size)") \
        .withColumn("root", own)
    real = lambda c: F.when(F.col(c) != _LAST_ID, F.col(c))
    return result.select(real("id").alias(key), "version", F.col("n").alias("n_shingles"),
                         real("root.id").alias("component_id"), (node == F.col("root")).alias("kept"))
