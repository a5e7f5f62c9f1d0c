"""Physical-plan checks: the plans we want at scale, not just the right rows."""

import __spark_entry__ as entry
from conftest import SF_MID, SF_SMALL
from funnelry.operators import reports
from funnelry.sources import testdata


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_range_reaches_parquet_scan(spark):
    df = entry.queries()["date_range_scan"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-05" in plan


def test_projection_pruned_at_scan(spark):
    plan = _plan(entry.queries()["funnel_overall"](spark, SF_SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_unused_dimension_joins_are_removed(spark):
    plan = _plan(entry.queries()["funnel_overall"](spark, SF_SMALL))
    assert "customer.parquet" not in plan and "nation.parquet" not in plan and "part.parquet" not in plan
    plan = _plan(entry.queries()["channel_performance"](spark, SF_SMALL))
    assert "customer.parquet" in plan and "nation.parquet" not in plan


def test_metric_cube_scans_events_once(spark):
    plan = _plan(reports.metric_cube(testdata.load(spark, SF_MID).sessions()))
    assert plan.count("events.parquet") == 1
    # GROUPING SETS over the sessions counted by all three dimensions, not over the sessions
    below = plan[plan.index("Expand"):]
    assert below.index("HashAggregate(keys=[device") < below.index("FileScan")


def test_no_python_in_metric_plans(spark):
    for name in ["funnel_overall", "metric_cube", "device_ztest", "findings", "category_revenue",
                 "channel_performance", "clean_sessions", "purchase_lines"]:
        plan = _plan(entry.queries()[name](spark, SF_SMALL))
        for op in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
            assert op not in plan, (name, op)
    for name in ["hit_sequence", "nested_funnel", "event_log"]:
        plan = _plan(entry.queries()[name](spark, SF_SMALL))
        assert "Python" not in plan and "Pandas" not in plan
        assert ("Window" in plan) == (name != "nested_funnel"), name


def test_small_dimensions_broadcast(spark):
    plan = _plan(entry.queries()["hits_products"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_flags_partial_aggregation_before_shuffle(spark):
    plan = _plan(entry.queries()["clean_sessions"](spark, SF_SMALL))
    assert "partial_max" in plan or "partial_bool_or" in plan
    assert plan.count("Exchange hashpartitioning") >= 1


def test_hot_session_join_is_split_by_aqe(spark):
    """A session holding a third of all hits: the hit->session join is skew-split."""
    from pyspark.sql import functions as F
    from funnelry.operators import cleaning
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string"))
        hits = spark.range(0, 40000, 1, 8).select(hot.alias("session_id"),
                                                   (F.col("id") % 7).cast("int").alias("eCommerceAction_action_type"))
        sess = spark.range(0, 500).select(F.col("id").cast("string").alias("session_id")).unionByName(
            spark.range(1).select(F.lit("hot").alias("session_id")))
        sess = sess.select("session_id", F.lit("Direct").alias("channel"), F.lit("desktop").alias("device"),
                           F.current_date().alias("date"))
        j = cleaning.join_hits_sessions(hits, sess)
        assert len(j.collect()) == 40000
        assert "SortMergeJoin(skew=true)" in _plan(j)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_purchase_queries_push_event_type_to_scan(spark):
    for name in ["purchase_lines", "category_revenue"]:
        plan = _plan(entry.queries()[name](spark, SF_SMALL))
        assert "EqualTo(event_type,purchase)" in plan, name


def test_code_filter_matches_derived_code(spark):
    from pyspark.sql import functions as F
    for codes in ([6], [2, 3], [0], [0, 5]):
        pushed = testdata.raw_hits(spark, SF_SMALL, codes=codes)
        derived = testdata.raw_hits(spark, SF_SMALL).where(F.col("eCommerceAction_action_type").isin(*codes))
        assert pushed.exceptAll(derived).count() == 0 and derived.exceptAll(pushed).count() == 0, codes


def test_dimension_joins_fall_back_to_shuffle_joins(spark):
    """Above the broadcast threshold the same queries plan sort-merge joins, same rows."""
    names = ["channel_performance", "category_revenue", "hits_products"]
    before = {n: sorted(map(tuple, entry.queries()[n](spark, SF_SMALL).collect()), key=str) for n in names}
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        for n in names:
            df = entry.queries()[n](spark, SF_SMALL)
            assert sorted(map(tuple, df.collect()), key=str) == before[n], n
            plan = _plan(df)
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, n
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
