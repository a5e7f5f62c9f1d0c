"""Approximate nearest neighbours against all distances."""

import math

import numpy as np
import pytest
from funnelry.llm import nearest, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, `a.b` string, query_id long, score double"


def plain(rows, asks, k):
    """All distances, as the rule has them: query -> [(distance, id)]."""
    width = max((len(v) for _, v in rows if v), default=0)
    fit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fit[(i, tuple(float(np.float32(x)) + 0.0 for x in v) + (0.0,) * (width - len(v)))] = None
    out = {}
    for q, a in fit:
        if asks(q):
            found = []
            for i, b in fit:
                if (i, b) != (q, a):
                    total = 0.0
                    for x, y in zip(a, b):
                        total += (x - y) * (x - y)
                    found.append((math.sqrt(total), i))
            out.setdefault(q, []).append(sorted(found)[:k])
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], SCHEMA)
    got = nearest.nearest(frame, F.col("vec_id") % 10 == 0, **options)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return out


def vectors(seed, n, width=32):
    rnd = np.random.default_rng(seed)
    centers = rnd.standard_normal((12, width))
    return [(i, [float(np.float32(x)) for x in centers[i % 12] * .5 + rnd.standard_normal(width)]) for i in range(n)]


def test_all_lists_probed_gives_exact_results_with_copies_ties_and_odd_vectors(spark):
    rows = vectors(1, 300)
    rows += [(1000 + i, rows[20][1]) for i in range(40)] + [(None, rows[3][1]), (2000, None), (2010, []), (2020, [0.0, -0.0]),
            (2030, [1.0, None]), (2040, [float("nan")]), (2050, [float("inf")]), (2060, [1.0, 2.0]), (2070, [-0.0, 3.0])] + rows[:5]
    want = plain(rows, lambda i: i % 10 == 0, 10)
    got = found(spark, rows, target=1.0, epsilon=1e9, part=64)
    assert set(got) == set(want)
    for q, (best,) in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(best) + 1))
        assert [(s, i) for _, s, i in got[q]] == best


def test_few_rows_and_empty_tables(spark):
    assert found(spark, []) == {} and found(spark, [(10, None)]) == {} and found(spark, [(10, [1.0])]) == {}
    assert found(spark, [(10, [1.0]), (11, [3.0]), (12, [0.0, 1.0])]) == {10: [(1, math.sqrt(2.0), 12), (2, 2.0, 11)]}
    assert found(spark, [(11, [1.0]), (12, [2.0])]) == {}


def test_vectors_of_one_id_are_rows_each(spark):
    rows = [(10, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 3)) for r in got) == sorted(
        [(10, 1, 11, 0.0), (10, 2, 10, 1.414), (10, 1, 10, 1.414), (10, 2, 11, 1.414), (11, 1, 10, 0.0), (11, 2, 10, 1.414)])


def recall(rows, got, want):
    hits = sum(len({i for _, _, i in got.get(q, [])} & {i for _, i in best}) for q, (best,) in want.items())
    return hits / sum(len(best) for best, in want.values())


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_with_production_parameters(spark, clustered):
    rows = vectors(7, 3000) if clustered else [(i, [float(np.float32(x)) for x in v])
                                                for i, v in enumerate(np.random.default_rng(8).standard_normal((3000, 32)))]
    got = found(spark, rows)
    assert recall(rows, got, plain(rows, lambda i: i % 10 == 0, 10)) >= 0.9


def test_recall_of_the_query_on_a_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    out = {}
    for r in queries.QUERIES["op12_nearest"](spark, sf).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = plain(rows, lambda i: i % 100 == 0, 10)
    assert set(out) == set(want) and recall(rows, out, want) >= 0.95


def test_hypothesis_test_abandons_candidates_early():
    rnd = np.random.default_rng(3)
    data, query = rnd.standard_normal((4000, 64)) * rnd.uniform(1, 3, (4000, 1)), rnd.standard_normal(64)
    turn = nearest.rotation_of(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    exact = nearest.squares(data, np.broadcast_to(query, data.shape))
    least = float(np.sort(exact)[9])
    turned = data @ turn
    read = []

    class Block(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                read.append(len(at))
            return np.asarray(self)[at]

    blocks = [np.ascontiguousarray(turned[:, a:a + 16]).view(Block) for a in range(0, 64, 16)]
    best, _ = nearest.scan_list(query, query @ turn, least, data, blocks, np.arange(4000), 10, nearest.EPSILON)
    assert set(best) == set(np.argsort(exact)[:10])
    assert sum(read) < 0.5 * 4 * 4000  # of all values, those that were looked at
