"""Line dedup by winnowing over line hashes.

Lines are compared without the blanks around them; blank lines are left out of
the comparison and kept. Of the line grams in each window the smallest hash is a
fingerprint, so any repeated run of ``min_lines`` lines has a common one.
Fingerprints that occur twice are joined to their positions; from each the
match is extended both ways over all runs of ``min_lines`` lines that contain it.
A run that also starts earlier, by (doc_id, line), is a later repeat: each of its
lines is deleted. Longer repeats are unions of such runs.

A single line of ``passage_words`` words or more is a passage, and a run by itself, whatever
its neighbours, with the same join and first place. Shorter lines, such as stock lines
that many texts have, go only within a run.

No pairs are made: equal runs find their first place by a minimum that is
combined before the shuffle, whatever the number of copies.

Defined cases: a null doc_id comes before all others; rows of one doc_id come in
the order of their text's hash; repeated rows of one id and text are one document and
get the same result; null text stays null, without lines; an empty table gives
no rows; other columns pass through and may have any name but those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .tasks import column, record_batch, small_batches, stored

MIN_LINES, GRAM, PASSAGE_WORDS = 2, 1, 50
_BREAK = rolling.separator_table(lambda b: b == 10)
_FIRST_ID = -(1 << 63)


def row_key(key: Column, text: Column) -> list[Column]:
    """Orders and joins rows: the id, null first, and the hash of the text."""
    return [F.coalesce(key.cast("long"), F.lit(_FIRST_ID)).alias("id"), F.xxhash64(text).alias("version")]


def _lines(data: np.ndarray, bounds: np.ndarray):
    """Spans of all lines that aren't blank, without the blanks around them, and the bounds in lines."""
    starts, ends, _ = rolling.word_spans(data, bounds, _BREAK)
    inside = np.flatnonzero(~rolling.BLANK[data])
    a, b = np.searchsorted(inside, starts), np.searchsorted(inside, ends)
    said = b > a
    starts, ends = inside[a[said]], inside[b[said] - 1] + 1
    return starts, ends, np.searchsorted(starts, bounds)


_PRINTS = pa.schema([("print", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("first", pa.int32()),
                     ("passage", pa.bool_()), ("runs", pa.list_(pa.int64()))])
_KEPT = pa.schema([("kept", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64())])


def _fingerprints(rows: DataFrame, min_lines: int, gram: int, passage_words: int | None) -> DataFrame:
    """A row per fingerprint: its hash, its document, and the hashes of the runs that
    contain it (those of which it is the window minimum), the first from line ``first``.
    A long line is a run of its own, marked ``passage``, under a fingerprint that no other run has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.text_slices(batch, "text"):
                data, bounds = rolling.utf8_bytes(part.column("text"))
                starts, ends, own = _lines(data, bounds)
                lines = rolling.span_hashes(data, starts, ends)
                ids, versions = (part.column(c).to_numpy() for c in ("id", "version"))

                def prints(grams, first, passage, runs, cuts):
                    document = np.searchsorted(own, first, "right") - 1
                    return record_batch(
                        _PRINTS, rolling.signed(grams), ids[document], versions[document],
                        (first - own[document]).astype(np.int32), np.full(len(first), passage),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(rolling.signed(runs))))

                for runs, anchors in rolling.window_anchors(lines, own, gram, min_lines):
                    # runs of one fingerprint in one document are neighbours
                    new = np.flatnonzero(np.diff(anchors, prepend=-1))
                    yield prints(rolling.hash_at(lines, anchors[new], gram, rolling.GRAM_BASE), runs[new], False,
                                 rolling.hash_at(lines, runs, min_lines, rolling.WINDOW_BASE), np.append(new, len(runs)))
                if passage_words is not None:
                    words, _, _ = rolling.word_spans(data, bounds)
                    long = np.flatnonzero(np.searchsorted(words, ends) - np.searchsorted(words, starts) >= passage_words)
                    if len(long):
                        yield prints(rolling.mix(lines[long] ^ rolling.SECOND_BASE), long, True, lines[long],
                                     np.arange(len(long) + 1))

    return rows.mapInArrow(run, "print long, id long, version long, first int, passage boolean, runs array<long>")


def later_runs(docs: DataFrame, key: str, text: str, min_lines: int = MIN_LINES, gram: int = GRAM,
               passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """(id, version, starts, alone): the lines from which a later repeat of ``min_lines`` lines
    starts, and those that are later repeats of a passage by themselves."""
    rows = docs.select(*row_key(F.col(key), F.col(text)), F.col(text).alias("text"))
    prints = stored(_fingerprints(rows, min_lines, gram, passage_words), "line-prints")
    # joins on a new key: both sides are exchanged, and adaptive execution can split a very common line or run
    twice = prints.groupBy("print").count().where("count > 1").select(F.xxhash64("print").alias("at"), F.col("print").alias("p"))
    runs = prints.withColumn("at", F.xxhash64("print")).join(twice, "at").where("print = p").select(
        "print", "id", "version", "passage", F.posexplode("runs").alias("place", "run"), "first") \
        .select("run", "print", "id", "version", "passage", (F.col("first") + F.col("place")).alias("line"))
    runs = stored(runs, "line-runs")
    place = F.struct("id", "version", "line")
    firsts = runs.groupBy("run", "print").agg(F.min(place).alias("earliest"), F.count("*").alias("n")) \
        .where("n > 1").select(F.xxhash64("run", "print").alias("same"), F.col("run").alias("r"),
                               F.col("print").alias("p"), "earliest")
    later = runs.withColumn("same", F.xxhash64("run", "print")).join(firsts, "same") \
        .where((F.col("run") == F.col("r")) & (F.col("print") == F.col("p")) & (place != F.col("earliest")))
    return later.groupBy("id", "version").agg(F.collect_set(F.when(~F.col("passage"), F.col("line"))).alias("starts"),
                                              F.collect_set(F.when(F.col("passage"), F.col("line"))).alias("alone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
                gram: int = GRAM, passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """The rows with ``text`` rid of later repeats, and n_lines (not blank), n_removed
    and n_runs (maximal stretches of removed lines)."""
    small_batches(docs.sparkSession)
    found = later_runs(docs, key, text, min_lines, gram, passage_words)
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_removed", "n_runs")]
    others = F.struct(*[column(c) for c in rest]).alias("others") if rest else F.lit(None).alias("others")
    rows = docs.select(*row_key(F.col(key), F.col(text)), F.col(text).alias("text"), others) \
        .join(found, ["id", "version"], "left").select("others", "text", "starts", "alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.text_slices(batch, "text"):
                data, bounds = rolling.utf8_bytes(part.column("text"))
                begin, end, own = _lines(data, bounds)
                kept, counts = [], []
                for i, (text_, *places) in enumerate(zip(*map(part.column, ("text", "starts", "alone")))):
                    n = int(own[i + 1] - own[i])
                    starts, alone = (np.array(p.as_py() or [], np.int64) for p in places)
                    if not len(starts) + len(alone):
                        kept.append(text_.as_py())
                        counts.append((n, 0, 0))
                        continue
                    gone = rolling.covered(starts, min_lines, n) | rolling.covered(alone, 1, n)
                    drop = {int(np.searchsorted(breaks, b)) for breaks in [
                        np.flatnonzero(data[bounds[i]:bounds[i + 1]] == 10) + bounds[i]]
                        for b in begin[own[i]:own[i + 1]][gone]}
                    kept.append("\n".join(x for j, x in enumerate(text_.as_py().split("\n")) if j not in drop))
                    counts.append((n, int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone))))
                out = record_batch(_KEPT, kept, *zip(*counts))
                yield pa.RecordBatch.from_arrays([part.column("others"), *out.columns],
                                                 names=["others", *_KEPT.names])

    schema = T.StructType([T.StructField("others", rows.schema["others"].dataType if rest else T.StringType()),
                           T.StructField("kept", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_runs")]])
    done = rows.withColumn("others", F.col("others").cast(schema["others"].dataType)).mapInArrow(run, schema)
    back = [F.col("others")[c].alias(c) for c in rest]
    return done.select(*back, F.col("kept").alias(text), "n_lines", "n_removed", "n_runs")
