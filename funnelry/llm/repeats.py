"""Strings that occur twice in a corpus: chunks of documents and the seeds they share.

Documents are dealt by the hash of their id into chunks of bounded size. In each
window of ``length`` units (words or bytes) the smallest hash of ``k`` units is its
anchor, and the anchor's hash is the window's seed. Equal windows have equal
seeds at equal offsets. Chunks send their distinct seeds with counts to buckets,
and get back those that occur twice in the corpus; only windows of these go on.

Seeds that occur ``HOT`` times or more are marked: their windows are then dealt by
each window's own hash, so that a passage that very many documents share is
spread over many tasks. The result is the same either way.

A chunk asks a bucket about each distinct string once, however often it occurs in the chunk, and
keeps the places where it does to itself: they travel to the chunk's own last step, under a key of the
chunk's own. So a bucket's group grows with the chunks that know a string, never with its occurrences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling

CHUNK_BYTES = 4 << 20
HOT = 20_000
LAST_ID = (1 << 63) - 1
U64 = np.uint64
#: Bits of a seed, and the bytes it is sent in. Seeds only choose candidates.
SEED_BITS, SEED_BYTES = 48, 6
#: Gives the bytes and bounds of a chunk's texts their units and the bounds in units.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def chunked(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(chunk, id, version, text) of each row, and the number of chunks. A null id is the largest."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("version"),
                       F.coalesce(text, F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    return rows.select(F.pmod(F.xxhash64("id", "version"), F.lit(n)).alias("chunk"), "id", "version", "text"), n


def in_order(chunk: pa.Table) -> pa.Table:
    """The chunk's documents in an order that doesn't depend on how they arrived."""
    return chunk.sort_by([("id", "ascending"), ("version", "ascending")]).combine_chunks()


def texts_of(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = chunk.column("text")
    return rolling.utf8_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def anchor_runs(units: np.ndarray, bounds: np.ndarray, k: int, length: int):
    """(seeds, first, n): the windows from n neighbouring starts that have one anchor."""
    none = np.zeros(0, np.int64)
    seeds, firsts, counts = [np.zeros(0, U64)], [none], [none]
    for starts, anchors in rolling.window_anchors(units, bounds, k, length):
        new = np.flatnonzero(np.diff(anchors, prepend=-1))
        seeds.append(rolling.hash_at(units, anchors[new], k, rolling.GRAM_BASE) >> U64(64 - SEED_BITS))
        firsts.append(starts[new])
        counts.append(np.diff(np.append(new, len(starts))))
    return np.concatenate(seeds), np.concatenate(firsts), np.concatenate(counts)


def blob(values: np.ndarray, kind: str) -> bytes:
    """Values as compressed bytes: what is shuffled is a few large cells, not rows."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype=kind).tobytes())


def unblob(column, kind: str) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(expand(b), kind) for b in column.to_pylist()]


def packed_seeds(seeds: np.ndarray) -> bytes:
    return seeds.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SEED_BYTES].tobytes()


def unpacked_seeds(column) -> list[np.ndarray]:
    out = []
    for cell in column.to_pylist():
        wide = np.zeros((len(cell) // SEED_BYTES, 8), np.uint8)
        wide[:, :SEED_BYTES] = np.frombuffer(cell, np.uint8).reshape(-1, SEED_BYTES)
        out.append(wide.view("<u8").ravel())
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (rolling.mix(hashes) % U64(buckets)).astype(np.int64)


def by_bucket(buckets: np.ndarray):
    """Pairs (bucket, places) of the places with each bucket."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    return [(int(buckets[part[0]]), part) for part in np.split(order, cuts)] if len(order) else []


def repeated_seeds(chunks: DataFrame, n: int, units: Units, k: int, length: int, hot: int = HOT) -> DataFrame:
    """(chunk, seeds, hot): for each chunk its seeds that occur twice in the corpus, as
    bytes of sorted hashes, and a byte for each that tells whether it is hot."""

    def seeds(table: pa.Table) -> pa.Table:
        found, _, _ = anchor_runs(*units(*texts_of(table)), k, length)
        found, counts = np.unique(found, return_counts=True)
        rows = [(b, packed_seeds(found[at]), blob(np.minimum(counts[at], 1 << 20), "<u4"))
                for b, at in by_bucket(bucket_of(found, n))]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()),
                         "chunk": pa.array([chunk] * len(rows), pa.int64()),
                         "seeds": pa.array([r[1] for r in rows], pa.binary()),
                         "counts": pa.array([r[2] for r in rows], pa.binary())})

    def twice(table: pa.Table) -> pa.Table:
        parts, counts = unpacked_seeds(table.column("seeds")), unblob(table.column("counts"), "<u4")
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts))[place]
        rows, at = [], 0
        for chunk, own in zip(table.column("chunk").to_pylist(), parts):
            sums = total[at:at + len(own)]
            at += len(own)
            often = sums >= 2
            if often.any():
                rows.append((chunk, packed_seeds(own[often]), blob(sums[often] >= hot, "u1")))
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()),
                         "seeds": pa.array([r[1] for r in rows], pa.binary()),
                         "hot": pa.array([r[2] for r in rows], pa.binary())})

    sent = chunks.groupBy("chunk").applyInArrow(seeds, "bucket long, chunk long, seeds binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(twice, "chunk long, seeds binary, hot binary")


def chosen_runs(units: np.ndarray, bounds: np.ndarray, k: int, length: int, shared: pa.Table):
    """The anchor runs of a chunk whose seed is among those of ``shared``; runs of hot
    seeds are cut into single windows. (seeds, first, n, hot)."""
    seeds, first, n = anchor_runs(units, bounds, k, length)
    known = np.concatenate([np.zeros(0, U64), *unpacked_seeds(shared.column("seeds"))])
    marks = np.concatenate([np.zeros(0, np.uint8), *unblob(shared.column("hot"), "u1")])
    order = np.argsort(known)
    known, marks = known[order], marks[order]
    if not len(known):
        return seeds[:0], first[:0], n[:0], np.zeros(0, bool)
    at = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
    chosen = known[at] == seeds
    seeds, first, n, hot = seeds[chosen], first[chosen], n[chosen], marks[at[chosen]].astype(bool)
    if hot.any():
        times = np.where(hot, n, 1)
        heads = np.repeat(np.cumsum(times) - times, times)
        step = np.arange(int(times.sum())) - heads
        seeds, first, hot = np.repeat(seeds, times), np.repeat(first, times) + step, np.repeat(hot, times)
        n = np.where(hot, 1, np.repeat(n, times))
    return seeds, first, n, hot


def own_group(chunk: int) -> int:
    """The key under which a chunk's places travel: no bucket has it."""
    return -1 - chunk


def binary_table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows of longs and bytes as a table of that schema."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table([pa.array(c, pa.int64() if kind == "long" else pa.binary()) for c, (_, kind) in zip(columns, fields)],
                    names=[name for name, _ in fields])


def places_and_answers(found: pa.Table, *kinds: tuple[str, str]):
    """For each bucket that has answered a chunk: its answers (of the given kinds, for each distinct string), and of
    these strings' occurrences the string, document and first unit."""
    rows = found.to_pylist()
    answers = {r["bucket"]: r for r in rows if r["docs"] is None}
    expand = zstandard.ZstdDecompressor().decompress
    for own in rows:
        answer = answers.get(own["bucket"])
        if own["docs"] is None or answer is None:
            continue
        times, docs, firsts = (np.frombuffer(expand(own[c]), kind) for c, kind in (("times", "<u4"), ("docs", "<i4"), ("firsts", "<i8")))
        yield [np.frombuffer(expand(answer[c]), kind) for c, kind in kinds], np.repeat(np.arange(len(times)), times), docs, firsts


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n windows each: the run of every window, and its place in the run."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
