"""Compression classifier: zstandard dictionaries of good and of bad text.

A text is cut into chunks, each compressed with either dictionary. The
normalised difference of the compressed sizes, (bad - good) / (bad + good), with
the compression ratio and the length as context, goes through a logistic
calibration to a score from 0 to 1, higher where label 1 is likelier.

The dictionaries come from one part of a bounded sample of labelled rows, the
calibration from another. The bounds are parameters: ``per_class`` documents of
each label for either part, ``sample_chars`` characters of each for the
dictionaries. The calibration measures its texts whole, in tasks, as scoring does;
only their sizes come to the driver. Of rows that share a sampled id one counts.

Defined cases: null and empty texts get a score like any other (all sizes 0);
labels that contradict each other for one id, null labels and null ids teach
nothing; with labels of one kind only, the score is that label, without any 0.5;
repeated rows are scored each; an empty table gives no rows; columns beyond the
named ones pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tasks import column, small_batches

PER_CLASS, SAMPLE_CHARS = 2000, 16_384
CHUNK, DICTIONARY_BYTES, LEVEL = 1024, 32_768, 1
#: A line that this many sampled documents share says nothing about quality.
SHARED_LINE = 3
ACCEPT = 0.7


@dataclass
class Model:
    """``good`` and ``bad`` are dictionaries; without them every score is ``constant``."""

    constant: float = 0.5
    good: bytes = b""
    bad: bytes = b""
    raw: bool = False
    mean: tuple = ()
    scale: tuple = ()
    weights: tuple = ()


def _compressor(dictionary: bytes, raw: bool):
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_checksum=False,
                                    write_content_size=False, write_dict_id=False).compress


def _chunks(data: bytes) -> list[bytes]:
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


def sizes(texts: list[bytes], good, bad) -> np.ndarray:
    """Of each text the bytes by either dictionary, and those it has."""
    rows = np.empty((len(texts), 3))
    for i, text in enumerate(texts):
        a = b = 0
        for chunk in _chunks(text):
            a += len(good(chunk))
            b += len(bad(chunk))
        rows[i] = a, b, len(text)
    return rows


def features(rows: np.ndarray) -> np.ndarray:
    a, b, size = rows.T
    difference = (b - a) / np.maximum(a + b, 1)
    ratio = np.log((a + 5) / (size + 20))
    length = np.log(size + 20)
    return np.column_stack([difference, ratio, ratio ** 2, length, difference * length])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w


def _training_text(texts: list[str]) -> list[list[bytes]]:
    """Chunks of each text without the lines that several of them share."""
    seen: dict[str, int] = {}
    for text in texts:
        for line in set(text.split("\n")):
            seen[line] = seen.get(line, 0) + 1
    own = ("\n".join(line for line in text.split("\n") if seen[line] < SHARED_LINE) for text in texts)
    return [_chunks(text.encode()) for text in own]


def dictionaries(teach: list[tuple[str, int]]) -> tuple[bytes, bytes, bool]:
    """Those of good and of bad text, from (text, label) of both labels, and whether they are raw text."""
    chunks = _training_text([text for text, _ in teach])
    parts = {label: [c for (_, known), own in zip(teach, chunks) if known == label for c in own] for label in (0, 1)}
    raw = False
    try:
        good, bad = (zstandard.train_dictionary(DICTIONARY_BYTES, parts[label]).as_bytes() for label in (1, 0))
    except zstandard.ZstdError:  # too little text to choose from: the text itself is the dictionary
        raw = True
        good, bad = (b"\n".join(parts[label])[-DICTIONARY_BYTES:].ljust(8) for label in (1, 0))
    return good, bad, raw


def calibrated(good: bytes, bad: bytes, raw: bool, rows: np.ndarray, labels: list[int]) -> Model:
    """The model of the dictionaries, from the sizes of texts and their labels."""
    x = features(rows)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    weights = _logistic((x - mean) / scale, np.array(labels, float))
    return Model(0.5, good, bad, raw, tuple(mean), tuple(scale), tuple(weights))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def spread_pieces(text: Column, most: int, size: int = CHUNK) -> Column:
    """The text if it has at most ``most`` characters, else whole pieces of ``size`` characters from all
    over it, chosen by a hash of the text and the piece's place, in their order."""
    places = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(i, F.xxhash64(text)).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, max(1, most // size)), lambda r: r["i"]))
    pieces = F.transform(chosen, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(pieces, "\n"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from ``per_class`` documents of each label for the dictionaries and as
    many for the calibration, chosen by the hash of their id, never from held-out ids."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).dropna() \
        .where(F.col("label").isin(0, 1) & ~F.coalesce(held_out(F.col("id")), F.lit(True))) \
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    order = F.xxhash64("id")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).select("id", "label").orderBy(order, "id").limit(2 * per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    present = docs.select(F.col(key).alias("id")).join(F.broadcast(chosen), "id").select("id", "label").distinct()
    sample = sorted(map(tuple, present.collect()))  # at most 4 * per_class
    parts = ([], [])
    seen = {0: 0, 1: 0}
    for i in np.random.default_rng(5).permutation(len(sample)):  # each label goes half to either part
        value = sample[i][1]
        parts[seen[value] % 2].append(sample[i])
        seen[value] += 1
    if any({value for _, value in part} != {0, 1} for part in parts):
        return Model(constant=float(np.mean([value for _, value in sample])) if sample else 0.5)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    teach, calibrate = (texts.join(F.broadcast(docs.sparkSession.createDataFrame(part, present.schema)), "id")
                        for part in parts)
    # one row of an id, that with the smallest hash, is what counts and is collected
    first = F.min_by(spread_pieces(F.col("text"), sample_chars), F.xxhash64("text")).alias("text")
    taught = sorted((r.id, r.text, r.label) for r in teach.groupBy("id", "label").agg(first).collect())
    good, bad, raw = dictionaries([(said, value) for _, said, value in taught])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _compressor(good, raw), _compressor(bad, raw)
        for batch in batches:
            if batch.num_rows:
                rows = sizes(batch.column(3).cast(pa.large_binary()).to_pylist(), *by).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, rows.T)],
                                                 names=["id", "label", "version", "a", "b", "size"])

    kind = present.schema["id"].dataType.simpleString()
    measured = calibrate.select("id", "label", F.xxhash64("text").alias("version"), "text") \
        .mapInArrow(measure, f"id {kind}, label int, version long, a long, b long, size long") \
        .groupBy("id", "label").agg(F.min(F.struct("version", "a", "b", "size")).alias("least")) \
        .select("id", "label", "least.a", "least.b", "least.size")
    rows = sorted(map(tuple, measured.collect()))
    return calibrated(good, bad, raw, np.array([r[2:] for r in rows], float), [r[1] for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
          accept: float | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (default all) of each row and its score, under ``name``; with
    ``accept`` only rows with at least that score. A column of that name is replaced."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows = docs.select(*[column(c) for c in keep], F.coalesce(text, F.lit("")).alias("__text"))
    mean, scale, weights = map(np.array, (model.mean, model.scale, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.good:
            good, bad = _compressor(model.good, model.raw), _compressor(model.bad, model.raw)
        for batch in batches:
            if not batch.num_rows:
                continue
            if model.good:
                said = batch.column(len(keep)).cast(pa.large_binary()).to_pylist()
                x = (features(sizes(said, good, bad)) - mean) / scale
                scores = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            else:
                scores = np.full(batch.num_rows, model.constant)
            out = pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(scores)], names=[*keep, name])
            yield out if accept is None else out.filter(pc.greater_equal(out.column(len(keep)), accept))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:len(keep)], T.StructField(name, T.DoubleType())]))
