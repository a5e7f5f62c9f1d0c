import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry import schema as S
from funnelry.operators import nested
from funnelry.sources import files, testdata


def by_hour():
    return dict(bucket=F.hour("ts"), order=testdata.SEQUENCE_ORDER)

FLAGS = ["reached_product_view", "reached_cart", "reached_checkout"]


def _nested_rows(spark, rows):
    return spark.createDataFrame(rows, S.NESTED_SESSIONS)


def test_exists_flags_edge_cases(spark):
    hit = lambda n, code: (n, (code,))
    rows = [
        ("v1", 1, "20161101", "Direct", ("desktop",), ("US",), (3, 1, 5000000), [hit(1, "2"), hit(2, "6")]),
        ("v2", 2, "20161101", "Direct", ("mobile",), ("US",), (1, None, None), []),
        ("v3", 3, "20161102", "Social", ("mobile",), ("IN",), (1, 0, None), None),
        ("v4", 4, "20161102", "Social", ("tablet",), ("IN",), (1, 0, None), [hit(1, None), None]),
    ]
    flat = {r.session_id: r for r in nested.flatten_nested(_nested_rows(spark, rows)).collect()}
    assert flat["v1-1"].reached_product_view and not flat["v1-1"].reached_cart
    assert flat["v1-1"].purchased and flat["v1-1"].revenue == 5.0
    for sid in ("v2-2", "v3-3", "v4-4"):
        assert [flat[sid][f] for f in FLAGS] == [False, False, False]
        assert flat[sid].purchased is False and flat[sid].revenue == 0.0


def _nest(m, **kw):
    return nested.to_nested_sessions(m.raw_sessions(), m.hits(), **(kw or by_hour()))


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_nested_equals_flat_path(spark):
    m = testdata.load(spark, SF_SMALL)
    a = nested.flatten_nested(_nest(m))
    assert _same(a, m.sessions().select(*a.columns))


def test_buckets_bound_arrays_and_flags_stay_one_row_per_session(spark):
    """A session of many hours and hits: many records, one row of flags."""
    m = testdata.load(spark, SF_SMALL)
    hits = spark.range(5000).select(
        F.lit("v-1").alias("session_id"), F.when(F.col("id") == 4321, 3).otherwise(0).alias("eCommerceAction_action_type"),
        "id", F.floor(F.col("id") / 100).cast("int").alias("part"))
    row = m.raw_sessions().limit(1).withColumn("session_id", F.lit("v-1")).withColumn("fullVisitorId", F.lit("v")) \
        .withColumn("visitId", F.lit(1).cast("long"))
    n = nested.to_nested_sessions(row, hits, bucket=F.col("part"), order=("id",))
    assert n.count() == 50 and n.select(F.max(F.size("hits"))).first()[0] == 100
    flat = nested.flatten_nested(n).collect()
    assert [(r.session_id, r.reached_product_view, r.reached_cart) for r in flat] == [("v-1", False, True)]


def test_arrays_follow_the_order_and_carry_hit_numbers(spark):
    m = testdata.load(spark, SF_SMALL)
    n = _nest(m, bucket=F.lit(0), order=("ts", "event_id"))
    numbered = nested.to_nested_sessions(m.raw_sessions(), m.hits(with_sequence=True), bucket=F.lit(0))
    codes = lambda f: f.select("fullVisitorId", "visitId", F.transform("hits", lambda h: h["eCommerceAction"]).alias("c"))
    assert _same(codes(n), codes(numbered))
    first = numbered.where(F.size("hits") > 1).first()
    assert [h.hitNumber for h in first.hits] == list(range(1, len(first.hits) + 1))


def test_date_partition_pruning(spark):
    m = testdata.load(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="nested-") + "/ga_sessions"
    _nest(m).write.partitionBy("date").parquet(path)
    df = files.read_nested_sessions(spark, path, date_from="20240105", date_to="20240110")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "20240105" in plan
    got = nested.flatten_nested(df).count()
    expect = m.raw_sessions().where(F.col("date").between("20240105", "20240110")).count()
    assert got == expect and got > 0


def test_json_and_parquet_give_the_same_rows(spark):
    """Our own records, and a plain export in which one visit occurs twice."""
    m = testdata.load(spark, SF_SMALL)
    hit = lambda n, code: (n, (code,))
    plain = _nested_rows(spark, [
        ("v1", 1, "20240102", "Direct", ("desktop",), ("US",), (3, 1, 5000000), [hit(1, "2")]),
        ("v1", 1, "20240102", "Social", ("mobile",), ("IN",), (1, None, None), [hit(1, "3")])])
    for frame, rows in ((_nest(m), m.raw_sessions().count()), (plain, 2)):
        base = tempfile.mkdtemp(prefix="nested-both-")
        frame.write.json(f"{base}/json")
        frame.write.parquet(f"{base}/parquet")
        got = [nested.flatten_nested(files.read_nested_sessions(spark, f"{base}/{f}", f, "20240101", "20240131"))
               for f in ("json", "parquet")]
        assert _same(*got) and got[0].count() == rows
    assert sorted((r.device, r.reached_cart, r.revenue) for r in got[0].collect()) == [("desktop", False, 5.0), ("mobile", True, 0.0)]


def test_sessions_of_one_id_keep_their_own_fields(spark):
    m = testdata.load(spark, SF_SMALL)
    one = m.raw_sessions().limit(1).withColumn("session_id", F.lit("x"))
    two = one.withColumn("deviceCategory", F.lit("other")).withColumn("totals_transactions", F.lit(9))
    hits = m.hits().limit(5).withColumn("session_id", F.lit("x"))
    flat = nested.flatten_nested(nested.to_nested_sessions(one.unionByName(two), hits, **by_hour())).collect()
    assert len(flat) == 2
    assert {r.device: r.purchased for r in flat}["other"] is True


def test_daily_trend_and_cube_from_nested_input(spark):
    from funnelry.api import FunnelAnalysis
    m = testdata.load(spark, SF_SMALL)
    fa = FunnelAnalysis.from_nested(_nest(m))
    flat = FunnelAnalysis.from_clean(m.sessions())
    assert _same(fa.daily(), flat.daily()) and _same(fa.cube(), flat.cube())
