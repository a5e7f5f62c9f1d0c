"""Ranked lexical search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from funnelry.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    counts = [(i, Counter(TERM.findall(brute.lower(text)))) for i, text in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERM.findall(brute.lower(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in terms if c[t])
            if s:
                scores.append((-s, doc is None, doc))
        out.extend((item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1))
    return sorted(out)


def found(spark, docs, items, **options):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score long, `a.b` string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = lexical_search.rank_documents(table, asked, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    return [tuple(r) for r in got.collect()]


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Éa", "x_y", "İI", "a b", "AB"]
    return [(i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.choice([1, 5, 30, 300]))))
            for i in range(n)]


@pytest.mark.parametrize("size, k", [(16, 3), (4096, 50)])
def test_ranking_equals_plain_scoring(spark, size, k):
    docs = texts(1, 150) + [(500, None), (501, ""), (502, "..."), (None, "w1 w2 éa"), (503, "w9 " * 20000)] + [(600 + i, "w3 w30") for i in range(60)]
    docs += docs[:10]
    items = texts(2, 12) + [(3, "w39 W39 w38"), (40, None), (41, "?!"), (None, "w1"), (42, "nowhere"), (43, "w3 W30 nowhere")]
    assert sorted(found(spark, docs, items, size=size, k=k), key=lambda r: r[:2]) == ranked(docs, items, k)


def test_items_in_blocks_and_empty_tables(spark):
    docs, items = texts(3, 40), texts(4, 9)
    assert sorted(found(spark, docs, items, block_bytes=200, k=5)) == ranked(docs, items, 5)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_treap_cells_hold_the_maxima_of_their_quadrants():
    rnd = np.random.default_rng(5)
    for shape in ((1, 1), (3, 17), (40, 9)):
        grid = np.where(rnd.random(shape) < .3, rnd.integers(1, 1000, shape), 0)
        grid[0, 0] = 7
        rows, columns = np.nonzero(grid)
        treap = lexical_search.Treap(rows, columns, grid[rows, columns])
        cells = {(0, 0): 0}
        for level in range(treap.height + 1):
            side = 1 << (treap.height - level)
            for (r, c), cell in cells.items():
                assert treap.most[cell] == grid[r * side:(r + 1) * side, c * side:(c + 1) * side].max(initial=0)
            if level < treap.height:
                cells = {(2 * r + q // 2, 2 * c + q % 2): int(treap.child(np.array([cell]), np.array([q]))[0])
                         for (r, c), cell in cells.items() for q in range(4)}


def test_hashes_that_collide_are_told_apart_by_their_bytes():
    vocabulary = lexical_search.Vocabulary([b"abc", b"xyz"])
    vocabulary.starts[:] = vocabulary.starts[::-1]  # each hash now leads to the other term's bytes
    data = np.frombuffer(b"abc xyz", np.uint8)
    assert len(vocabulary.find(data, np.array([0, 4]), np.array([3, 7]))[0]) == 0
    assert len(lexical_search.Vocabulary([]).find(data, np.array([0]), np.array([3]))[0]) == 0


def test_impacts_stay_exact_beyond_64_bits():
    assert lexical_search.impacts_of(np.array([3]), np.array([10 ** 9]), 10 ** 12, 10 ** 15)[0] == 3 * 10 ** 9 // (3000 + 20 * (50 + 50 * 10 ** 21 // 10 ** 15))
