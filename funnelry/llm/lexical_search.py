"""Ranked lexical search with K2-treaps over blocks of the term-document grid.

The rows of the grid are the terms that the items ask for, its columns are the
documents of one block, and a cell holds the impact of a term in a document. A
K2-treap halves the grid both ways from level to level. Only quadrants that are not
empty have a cell; four bits per cell tell which, a running count of those bits
tells where the children are, and each cell stores the largest impact below it.

An item is a set of rows. Its paths descend jointly over ranges of documents: a range
knows, for each row, the cell that the path has reached, and the weighted sum of these
cells' maxima bounds the score of every document in it. The ranges with the largest
bounds are opened first, a handful at a time; at a single document the bound is
its score. Ranges below the item's k-th score so far are dropped, those that
equal it are not, as ties go by id.

Two scans: the first counts terms, document frequencies and the items' terms in each
document (a written table that both later steps read); the second builds the
treaps block by block in each task, where the documents lie, and searches
them. It starts with a fixed share of the documents, whose k-th scores are a lower
bound that prunes the rest. Nothing but each task's best is shuffled.

Defined cases: null and empty texts have no terms, count nowhere and are never
found; items without an id take no part; texts of one item id are one item, repeated
terms count once; repeated rows of a document are documents each; a null document id
is the largest; an item whose terms are nowhere, and an empty table, give no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .tasks import record_batch, small_batches, stored

K = 50
#: Documents of one treap, ranges opened at a time, and bytes of items that are handled in one go.
RANGE, OPENED, BLOCK_BYTES = 16_384, 64, 8 << 20
#: One document of so many is searched first.
SHARE = 16
LAST_ID = (1 << 63) - 1
_SPLIT = rolling.separator_table(lambda b: b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SET_BITS = np.array([bin(b).count("1") for b in range(16)], np.int64)


def terms_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    low = _LOWER[data]
    starts, ends, _ = rolling.word_spans(low, np.array([0, len(low)]), _SPLIT)
    return [low[a:b].tobytes() for a, b in zip(starts, ends)]


class Vocabulary:
    """The terms that are asked for, found in texts by their hash and then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = rolling.span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        self.data, self.hashes, self.rows = data, hashes[order], order.astype(np.int32)
        self.starts, self.sizes = starts[order], (ends - starts)[order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are terms that are asked for, and which ones."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        hashes = rolling.span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == ends - starts))
        for i in range(0, len(hit), 1 << 16):
            part = hit[i:i + (1 << 16)]
            size = self.sizes[at[part]]
            heads = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(heads, size)
            same = data[np.repeat(starts[part], size) + place] == self.data[np.repeat(self.starts[at[part]], size) + place]
            hit[i:i + (1 << 16)] = np.where(np.logical_and.reduceat(same, heads), part, -1)
        hit = hit[hit >= 0]
        return hit, self.rows[at[hit]]


_POSTINGS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


def _postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, n, terms, times) of each document that has terms: how many, and how often each of those asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.text_slices(batch, "text"):
                data, bounds = rolling.utf8_bytes(part.column("text"))
                data = _LOWER[data]
                starts, ends, own = rolling.word_spans(data, bounds, _SPLIT)
                hit, rows = shared.value.find(data, starts, ends)
                document = np.searchsorted(own, hit, "right") - 1
                code, times = np.unique((document << 32) | rows, return_counts=True)
                cuts = np.searchsorted(code >> 32, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in ((code & 0xFFFFFFFF).astype(np.int32), times)]
                n = np.diff(own)
                yield record_batch(_POSTINGS, part.column("id"), n, *lists).filter(pa.array(n > 0))

    return docs.mapInArrow(count, "id long, n long, terms array<int>, times array<long>")


class Treap:
    """A K2-treap of impacts, from the rows, columns and impacts of the cells that aren't empty."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.height = max(1, int(max(rows.max(), columns.max())).bit_length())
        code = np.zeros(len(rows), np.int64)  # quadtree order: the bits of row and column in turn
        for bit in range(self.height):
            code |= ((rows >> bit) & 1).astype(np.int64) << (2 * bit + 1) | ((columns >> bit) & 1).astype(np.int64) << (2 * bit)
        order = np.argsort(code)
        code, most = code[order], impacts[order].astype(np.int64)
        levels = [(code, most)]
        for _ in range(self.height):
            cells = code >> 2
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            code, most = cells[first], np.maximum.reduceat(most, first)
            levels.append((code, most))
        levels.reverse()
        self.most = np.concatenate([m for _, m in levels] + [np.zeros(1, np.int64)])  # the last stands for an empty cell
        masks, size = [], 0
        for (above, _), (below, _) in zip(levels, levels[1:]):
            heads = np.searchsorted(below >> 2, above)
            masks.append(np.bitwise_or.reduceat(1 << (below & 3), heads).astype(np.uint8))
            size += len(above)
        masks.append(np.zeros(len(levels[-1][0]) + 1, np.uint8))
        self.masks = np.concatenate(masks)
        counts = _SET_BITS[self.masks]
        self.first = 1 + np.cumsum(counts) - counts  # cells are numbered level by level, children after one another
        self.none = len(self.most) - 1

    def child(self, cells: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        mask = self.masks[cells]
        there = (mask >> quadrant) & 1
        return np.where(there == 1, self.first[cells] + _SET_BITS[mask & ((1 << quadrant) - 1)], self.none)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray, opened: int = OPENED) -> None:
        """Offers ``best`` the (score, id) of the columns that can be among the best for the rows."""
        inside = rows < 1 << self.height
        rows, weights = rows[inside], weights[inside]
        cells = np.zeros((1, len(rows)), np.int64)
        level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.most[cells] @ weights
        while True:
            open_ = bound >= max(1, best.least)
            if not open_.all():
                cells, level, column, bound = cells[open_], level[open_], column[open_], bound[open_]
            if not len(bound):
                return
            now = np.argpartition(-bound, opened - 1)[:opened] if len(bound) > opened else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[now] = False
            row_bit = (rows[None, :] >> (self.height - 1 - level[now])[:, None]) & 1
            halves = [self.child(cells[now], 2 * row_bit + side) for side in (0, 1)]
            new = np.concatenate(halves)
            new_level, new_column = np.tile(level[now] + 1, 2), np.concatenate([2 * column[now], 2 * column[now] + 1])
            new_bound = self.most[new] @ weights
            done = new_level == self.height
            if done.any():
                found = done & (new_bound >= max(1, best.least))
                best.offer(new_bound[found], ids[new_column[found]])
            go = ~done & (new_bound >= max(1, best.least))
            cells, level = np.concatenate([cells[rest], new[go]]), np.concatenate([level[rest], new_level[go]])
            column, bound = np.concatenate([column[rest], new_column[go]]), np.concatenate([bound[rest], new_bound[go]])


class Best:
    """The k highest scores so far, ties to the smaller id; ``least`` is what a newcomer must reach."""

    def __init__(self, k: int, least: int = 0):
        self.k, self.least = k, least
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        top = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[top], ids[top]
        if len(top) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def impacts_of(times: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The impact of a term that occurs so many ``times`` in a document of ``n`` terms, in integers."""
    wide = n.astype(object) if int(n.max(initial=0)) * documents > (1 << 63) // 50 else n
    m = (50 + 50 * wide * documents // terms).astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 20 * m)


_FOUND = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])


def _search(postings: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, terms: int,
            k: int, least: dict[int, int], size: int) -> DataFrame:
    """(item, doc, score): for each item the best documents of each task that can be among the best of all."""
    shared = postings.sparkSession.sparkContext.broadcast((items, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, least = shared.value
        best = {item: Best(k, least.get(item, 0)) for item, _ in items}

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
            cells = np.diff(table.column("terms").combine_chunks().offsets.to_numpy())
            rows, times = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "times"))
            # documents of one kind lie side by side: by their most frequent term, then by length
            heads = np.cumsum(cells) - cells
            owner = np.repeat(np.arange(len(ids)), cells)
            often = np.lexsort((rows, -times, owner))[heads]
            place = np.empty(len(ids), np.int64)
            order = np.lexsort((ids, n, rows[often]))
            place[order] = np.arange(len(ids))
            treap = Treap(rows, place[owner], impacts_of(times, n[owner], documents, terms))
            for item, own in items:
                treap.search(own, weights[own], best[item], ids[order])

        waiting, held = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, size - held), batch.slice(min(batch.num_rows, size - held))
                waiting.append(part)
                held += part.num_rows
                if held == size:
                    search(waiting)
                    waiting, held = [], 0
        if held:
            search(waiting)
        for item, found in best.items():
            if len(found.ids):
                yield record_batch(_FOUND, np.full(len(found.ids), item), found.ids, found.scores)

    return postings.mapInArrow(run, "item long, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", k: int = K, size: int = RANGE, block_bytes: int = BLOCK_BYTES,
                   share: int = SHARE) -> DataFrame:
    """item_key, rank (from 1), key, score: the ``k`` documents of the highest score above 0 for each item.

    The items are measured and come to the driver in blocks of ``block_bytes``; each block
    is a scan of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).dropna()
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // block_bytes))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text).alias("text"))
    results = []
    for block in range(blocks):
        own: dict[int, set[bytes]] = {}
        for item, said in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).distinct().toLocalIterator():
            own.setdefault(item, set()).update(terms_of(said))
        results.append(_rank_block(rows, own, k, size, share))
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return found.select(F.col("item").alias(item_key), "rank", F.when(F.col("doc") != LAST_ID, F.col("doc")).alias(key), "score")


def _rank_block(rows: DataFrame, own: dict[int, set[bytes]], k: int, size: int, share: int) -> DataFrame:
    vocabulary = sorted(set().union(*own.values()))
    row_of = {term: i for i, term in enumerate(vocabulary)}
    postings = stored(_postings(rows, Vocabulary(vocabulary)), "postings")
    total = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counts = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in counts.toLocalIterator():  # one row for each term of the block at most
        weights[term] = math.floor(1000 * math.log((2 * total.documents + 2) / (2 * df + 1)))
    items = [(item, np.array(sorted(r for r in map(row_of.__getitem__, terms) if weights[r]), np.int64)) for item, terms in sorted(own.items())]
    items = [(item, chosen) for item, chosen in items if len(chosen)]
    told = (items, weights, total.documents, total.terms, k)
    full = postings.where(F.size("terms") > 0)
    early = F.pmod(F.xxhash64("id", "n"), F.lit(share)) == 0
    first = stored(_ranked(_search(full.where(early), *told, {}, size), k), "first-found")
    least = first.where(F.col("rank") == k).select("item", "score")
    later = _search(full.where(~early), *told, {r.item: r.score for r in least.toLocalIterator()}, size)
    return _ranked(first.select("item", "doc", "score").unionByName(later), k).select("item", "rank", "doc", "score")
