"""Property tests: custom operators against straightforward references."""

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from funnelry.functions.columns import percent_label
from funnelry.operators import cleaning
from funnelry.operators.sequence import sequence_within

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

keys = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "hot"]))
rows = st.lists(st.tuples(keys, st.integers(0, 5)), min_size=1, max_size=120)


@SETTINGS
@given(rows=rows, width=st.integers(1, 4))
def test_sequence_equals_row_number(spark, rows, width):
    data = [(k, t, i) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, t int, id long")
    got = sequence_within(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), name="seq")
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert sorted((r.id, r.seq) for r in got.collect()) == sorted((r.id, r.seq) for r in want.collect())


ids = st.one_of(st.none(), st.sampled_from(["s1", "s2", "s3", "s4"]))


@SETTINGS
@given(sess=st.lists(ids, max_size=12), hits=st.lists(ids, max_size=12))
def test_quality_report_matches_pandas(spark, sess, hits):
    s = spark.createDataFrame([(x,) for x in sess], "session_id string")
    h = spark.createDataFrame([(x,) for x in hits], "session_id string")
    q = cleaning.quality_report(s, h).first()
    ps, ph = pd.Series(sess, dtype=object), pd.Series(hits, dtype=object)
    assert q.sessions == len(sess) and q.hits == len(hits)
    assert q.duplicate_session_ids == int(ps.duplicated().sum())
    assert q.sessions_without_hits == int((~ps.isin(ph)).sum())


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 10**9)), min_size=1, max_size=30),
       decimals=st.integers(1, 3))
def test_percent_label_is_exact_half_up(spark, pairs, decimals):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r.p for r in df.select(percent_label("n", "d", decimals).alias("p")).collect()]
    q = Decimal(1).scaleb(-decimals)
    want = [None if d == 0 else f"{(Decimal(n) * 100 / Decimal(d)).quantize(q, rounding=ROUND_HALF_UP)}%"
            for n, d in pairs]
    assert got == want


session_rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", None]),
                                  st.sampled_from(["2024-01-01", "2024-01-02", "2024-01-03"]),
                                  st.booleans(), st.booleans(), st.booleans(), st.booleans(),
                                  st.one_of(st.none(), st.integers(0, 10**9))), min_size=0, max_size=60)


@SETTINGS
@given(rows=session_rows)
def test_cube_marginals_add_up(spark, rows):
    from funnelry.operators import reports
    df = spark.createDataFrame(
        [(f"s{i}", *r) for i, r in enumerate(rows)],
        "session_id string, device string, channel string, date string, reached_product_view boolean, "
        "reached_cart boolean, reached_checkout boolean, purchased boolean, revenue_micros long"
    ).withColumn("date", F.to_date("date"))
    cube = reports.metric_cube(df).collect()
    measures = ("sessions", "product_view", "cart", "checkout", "orders", "revenue_micros")

    def total(level, key=None, value=None):
        sel = [r for r in cube if r.level == level and (key is None or r[key] == value)]
        return tuple(sum(r[m] for r in sel) for m in measures)

    top = total(7) if any(r.level == 7 for r in cube) else (0,) * 6
    assert top[0] == len(rows)
    for level in (3, 5, 6, 1):                       # device, channel, date, device x channel
        assert total(level) == top
    for dev in ("a", "b", None):                     # the matrix rolls up to each device
        assert total(1, "device", dev) == total(3, "device", dev)
    for ch in ("x", "y", None):
        assert total(1, "channel", ch) == total(5, "channel", ch)
