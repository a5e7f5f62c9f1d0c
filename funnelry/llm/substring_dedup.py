"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

A reference block holds, for its share of the corpus' seeds (see ``repeats``), every distinct
string around them from every chunk, one after the other, and indexes the windows of ``length`` words in
it. Each string is parsed greedily against the block: a factor starts at an occurrence elsewhere
that the index gives, and follows the reference word by word as long as both go on alike; where it ends
the index is asked again, so that windows across a factor's end are judged too. Every window
in a factor also starts elsewhere, and a document's spans are the unions of its factors. An occurrence
elsewhere is another place of the block, or another copy of the same string.

Rule: a word goes if a window of ``length`` words that covers it also starts
anywhere else. Windows are judged on the input. Two windows are equal if 112 bits
of hash are (64 of the window, 48 of its seed).

Defined cases: null and empty texts have no words; a repeated row is another
document with the same words, so both lose them; a null id is kept; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, rolling
from .repeats import blob, unblob
from .tasks import small_batches

LENGTH, SEED = 35, 10


def _words(data: np.ndarray, bounds: np.ndarray):
    starts, ends, own = rolling.word_spans(data, bounds)
    return rolling.span_hashes(data, starts, ends), own


def factors(marked: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal chains (first word, past the last) of sorted places of marked windows."""
    if not len(marked):
        return []
    heads = np.flatnonzero(np.diff(marked, prepend=marked[0] - 2) > 1)
    tails = np.append(heads[1:], len(marked)) - 1
    return [(int(a), int(b) + length) for a, b in zip(marked[heads], marked[tails])]


_SENT = ("group long, bucket long, chunk long, seeds binary, windows binary, hashes binary, times binary, docs binary, "
         "firsts binary")
_BACK = "chunk long, bucket long, masks binary, times binary, docs binary, firsts binary"


def _sender(buckets: int, length: int, k: int):
    def send(chunk: pa.Table, shared: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if chunk.num_rows and shared.num_rows:
            chunk = repeats.in_order(chunk)
            own = int(chunk.column("chunk")[0].as_py())
            units, bounds = _words(*repeats.texts_of(chunk))
            seeds, first, n, hot = repeats.chosen_runs(units, bounds, k, length, shared)
            head = rolling.hash_at(units, first, length, rolling.WINDOW_BASE)
            tail = rolling.hash_at(units, first + n - 1, length, rolling.WINDOW_BASE)
            document = np.searchsorted(bounds, first, "right") - 1
            for bucket, at in repeats.by_bucket(repeats.bucket_of(np.where(hot, head, seeds), buckets)):
                # the first and the last window cover a run, so they tell equal runs
                order = np.lexsort((n[at], tail[at], head[at], seeds[at]))
                at = at[order]
                new = np.ones(len(at), bool)
                new[1:] = np.logical_or.reduce([c[at][1:] != c[at][:-1] for c in (seeds, head, tail, n)])
                heads = np.flatnonzero(new)
                one = at[heads]
                run, step = repeats.spread(n[one])
                times = blob(np.diff(np.append(heads, len(at))), "<u4")
                rows.append((bucket, bucket, own, repeats.packed_seeds(seeds[one]), blob(n[one], "<u2"),
                             blob(rolling.hash_at(units, first[one][run] + step, length, rolling.WINDOW_BASE), "<u8"),
                             times, None, None))
                rows.append((repeats.own_group(own), bucket, own, None, None, None, times, blob(document[at], "<i4"),
                             blob(first[at] - bounds[document[at]], "<i8")))
        return repeats.binary_table(rows, _SENT)

    return send


def parse_block(seeds: np.ndarray, n: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse of strings of ``n`` windows each against the block that they make up, ``hashes`` of whose windows
    come one after the other: for each window the place in the block that its factor follows there, or -1, and
    whether a factor starts at it. ``times``: how often the string occurs."""
    run, step = repeats.spread(n)
    size = len(run)
    order = np.lexsort((np.arange(size), seeds[run], hashes))
    new = np.ones(size, bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (seeds[run][order][1:] != seeds[run][order][:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, size))
    # the index: a window's first place in the block; for that place itself the second, or its own if the string has copies
    elsewhere = np.empty(size, np.int64)
    elsewhere[order] = np.repeat(order[heads], counts)
    alone = order[heads]
    second = order[np.minimum(heads + 1, size - 1)] if size else order
    elsewhere[alone] = np.where(counts > 1, second, np.where(times[run[alone]] > 1, alone, -1))
    follows = np.full(size, -1, np.int64)
    begins = np.zeros(size, bool)
    start = np.cumsum(n) - n
    for at in range(int(n.max(initial=0))):
        here = start[n > at] + at
        before = follows[here - 1] if at else np.full(len(here), -1)
        next_ = np.minimum(before + 1, size - 1)
        goes_on = (before >= 0) & (before + 1 < size) & (run[next_] == run[np.maximum(before, 0)]) \
            & (hashes[next_] == hashes[here]) & (seeds[run[next_]] == seeds[run[here]])
        follows[here] = np.where(goes_on, next_, elsewhere[here])
        begins[here] = ~goes_on & (follows[here] >= 0)
    return follows, begins


def _parser(table: pa.Table) -> pa.Table:
    """For each chunk, from a whole reference block: the masks of its distinct strings, bit j of a mask telling that window j
    lies in a factor. A chunk's own places pass through."""
    if table.column("group")[0].as_py() < 0:
        names = [x.split()[0] for x in _BACK.split(", ")]
        return repeats.binary_table([tuple(None if c == "masks" else r[c] for c in names) for r in table.to_pylist()], _BACK)
    kinds = {"windows": "<u2", "hashes": "<u8", "times": "<u4"}
    table = table.sort_by("chunk")
    parts = {c: unblob(table.column(c), kind) for c, kind in kinds.items()}
    parts["seeds"] = repeats.unpacked_seeds(table.column("seeds"))
    seeds, n, hashes, times = (np.concatenate(parts[c]) for c in ("seeds", "windows", "hashes", "times"))
    n = n.astype(np.int64)
    follows, _ = parse_block(seeds, n, hashes, times)
    run, step = repeats.spread(n)
    inside = np.flatnonzero(follows >= 0)
    masks = np.zeros(len(n), np.int64)
    np.bitwise_or.at(masks, run[inside], np.int64(1) << step[inside])
    rows, at = [], 0
    for chunk, bucket, own in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), parts["seeds"]):
        part = masks[at:at + len(own)]
        at += len(own)
        if part.any():
            rows.append((chunk, bucket, blob(part, "<i8"), None, None, None))
    return repeats.binary_table(rows, _BACK)


_CUT = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def _cutter(length: int):
    def cut(chunk: pa.Table, hits: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if chunk.num_rows:
            chunk = repeats.in_order(chunk)
            data, edges = repeats.texts_of(chunk)
            _, _, bounds = rolling.word_spans(data, edges)
            none = np.zeros(0, np.int64)
            parts = [(none, none, none)]
            for (masks,), string, docs, firsts in repeats.places_and_answers(hits, ("masks", "<i8")):
                hit = masks[string] != 0
                parts.append((docs[hit], firsts[hit], masks[string][hit]))
            docs, firsts, masks = map(np.concatenate, zip(*parts))
            width = int(masks.max()).bit_length() if len(masks) else 0
            starts = bounds[docs] + firsts
            marked = np.sort(np.concatenate([none, *(starts[(masks >> j) & 1 == 1] + j for j in range(width))]))
            own = np.searchsorted(marked, bounds)
            for i, (id_, version, text) in enumerate(zip(*(chunk.column(c).to_pylist() for c in ("id", "version", "text")))):
                found = factors(marked[own[i]:own[i + 1]] - bounds[i], length)
                words = text.encode().split()
                gone = np.zeros(len(words), bool)
                for a, b in found:
                    gone[a:b] = True
                kept = [w for w, drop in zip(words, gone.tolist()) if not drop] if found else words
                out.append((id_, version, len(words), int(gone.sum()), [{"start": a, "end": b} for a, b in found],
                            b" ".join(kept).decode()))
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)

    return cut


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED,
                 chunk_bytes: int = repeats.CHUNK_BYTES, hot: int = repeats.HOT) -> DataFrame:
    """One row per document: key, version (hash of its text), n_words, n_removed, spans
    (factors, in words) and kept, the words that remain, joined by single spaces.

    ``length`` may be up to ``seed`` + 61, so that a run's windows fit its mask.
    """
    small_batches(docs.sparkSession)
    chunks, n = repeats.chunked(docs, key, text, chunk_bytes)
    shared = repeats.repeated_seeds(chunks, n, _words, seed, length, hot)
    sent = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_sender(n, length, seed), _SENT)
    hits = sent.groupBy("group").applyInArrow(_parser, _BACK)
    cut = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(
        _cutter(length), "id long, version long, n_words long, n_removed long, "
                         "spans array<struct<start:long,end:long>>, kept string")
    real = F.when(F.col("id") != repeats.LAST_ID, F.col("id"))
    return cut.select(real.alias(key), "version", "n_words", "n_removed", "spans", "kept")
