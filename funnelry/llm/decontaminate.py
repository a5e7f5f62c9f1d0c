"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the
normalised test items, each text scanned once.

Words are runs of ASCII letters and digits and of any character beyond ASCII,
A-Z lower-cased. A window is ``length`` consecutive words of one item; an item of
fewer words is one window. Normalising keeps byte offsets, so that hits are
given as byte spans of the original text.

Defined cases: null or empty texts have no words and no hit; items without words
or without an id give no window; repeated items count once; a null doc_id is kept;
repeated rows are scanned and returned each; an empty table of items hits
nothing. Only the named columns are read.

The items are the one thing that is broadcast. Their size is measured first: in
blocks of at most ``block_bytes`` each, every block is an automaton of its own
that scans all texts, and a row carries its hits from one block to the next.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .tasks import column, record_batch, small_batches, worker_state

LENGTH = 10
BLOCK_BYTES = 32 << 20


def _normal_byte(b: int) -> int:
    if 65 <= b <= 90:
        return b + 32
    return b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32


#: Same length as the text: letters in lower case, all that separates words a space.
NORMAL = bytes(map(_normal_byte, range(256)))
_SPACE = rolling.separator_table(lambda b: b == 32)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def item_windows(items: list[tuple], length: int) -> dict[str, list]:
    """Each window, between single spaces, with the ids of the items that have it."""
    windows: dict[str, list] = {}
    for item_id, text in items:
        words = [w.decode() for w in normal_words(text)]
        if item_id is None:
            continue
        for at in range(max(1, len(words) - length + 1) if words else 0):
            owners = windows.setdefault(f" {' '.join(words[at:at + length])} ", [])
            if item_id not in owners:
                owners.append(item_id)
    return windows


def _automaton(key: str, items: list[tuple], length: int):
    state = worker_state()
    if state.get("automaton", ("",))[0] != key:
        found = ahocorasick.Automaton()
        for window, owners in item_windows(items, length).items():
            found.add_word(window, (window.count(" ") - 1, owners))
        found.make_automaton()
        state["automaton"] = (key, found if len(found) else None)
    return state["automaton"][1]


_OUT = pa.schema([("row", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("first", pa.list_(pa.int32())),
                  ("past", pa.list_(pa.int32())), ("begin", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())),
                  ("items", pa.list_(pa.int64()))])


def _hits(words: list[bytes], automaton) -> tuple[list[tuple[int, int]], set]:
    """Word ranges of all occurrences, and the ids of the items that have them."""
    text = f" {b' '.join(words).decode()} "
    found = list(automaton.iter(text))
    if not found:
        return [], set()
    spaces = [i for i, c in enumerate(text) if c == " "]
    past = [bisect_left(spaces, at) for at, _ in found]
    return [(p - n, p) for p, (_, (n, _)) in zip(past, found)], {i for _, (_, ids) in found for i in ids}


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH,
               block_bytes: int = BLOCK_BYTES, item_key: str = "item_id", item_text: str = "text",
               whole_rows: bool = False) -> DataFrame:
    """One row per document: key, n_words, n_hit, hit_spans (bytes of the text, end
    exclusive), items (ids of the items with occurring windows, distinct). With
    ``whole_rows`` all other columns of the row and its text come along, without a join."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    none = F.array().cast("array<int>")
    rest = [c for c in docs.columns if whole_rows and c not in (key, text, "n_words", "n_hit", "hit_spans", "items")]
    others = F.struct(*[column(c) for c in rest]) if rest else F.lit(None).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text"), others.alias("others"),
                       none.alias("first"), none.alias("past"), none.cast("array<long>").alias("items"))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        rows = _scan(rows, [tuple(r) for r in part.distinct().collect()], length, block == blocks - 1, whole_rows)
    n_hit = F.aggregate(F.arrays_zip("first", "past"), F.lit(0).cast("long"), lambda n, r: n + r["past"] - r["first"])
    back = [F.col("others")[c].alias(c) for c in rest] + [F.col("text").alias(text)] * whole_rows
    return rows.select(F.col("row").alias(key), *back, "n_words", n_hit.alias("n_hit"),
                       F.arrays_zip(F.col("begin").alias("start"), F.col("end")).alias("hit_spans"), "items")


def _scan(rows: DataFrame, items: list[tuple], length: int, last: bool, with_text: bool) -> DataFrame:
    """The rows with the hits of one block of items added; the last block drops the text unless it is wanted."""
    shared, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared.value, length)
        for batch in batches:
            for part in rolling.text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                known = zip(*(part.column(c).to_pylist() for c in ("first", "past", "items")))
                out = []
                for text, (first, past, owners) in zip(texts, known):
                    data = (text or "").encode().translate(NORMAL)
                    words = data.split()
                    ranges, ids = _hits(words, automaton) if automaton and words else ([], set())
                    ranges = _merged([*zip(first, past), *ranges])
                    first, past, begin, end = [a for a, _ in ranges], [b for _, b in ranges], [], []
                    if first and last:
                        codes = np.frombuffer(data, np.uint8)
                        starts, ends, _ = rolling.word_spans(codes, np.array([0, len(codes)]), _SPACE)
                        begin, end = starts[first].tolist(), ends[[p - 1 for p in past]].tolist()
                    out.append((None if last and not with_text else text, len(words), first, past, begin, end, sorted(ids.union(owners))))
                found = record_batch(_OUT, part.column("row"), *zip(*out))
                yield pa.RecordBatch.from_arrays([part.column("others"), *found.columns], names=["others", *_OUT.names])

    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    kinds = {"others": rows.schema["others"].dataType, "row": T.LongType(), "text": T.StringType(), "n_words": T.LongType(),
             "first": ints, "past": ints, "begin": longs, "end": longs, "items": longs}
    return rows.mapInArrow(scan, T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))


def leak_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of ``find_leaks``."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
