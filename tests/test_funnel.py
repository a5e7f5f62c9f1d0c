import math

from pyspark.sql import functions as F

from fixtures import clean
from funnelry import schema as S
from funnelry.operators import funnel, reports
from funnelry.plans import sql


def _close(a, b, tol=1e-6):
    if a is None or b is None:
        return a is b
    return abs(a - b) < tol


def test_funnel_frame_counts_and_steps(spark):
    rows = funnel.funnel_frame(clean(spark)).orderBy("stage_order").collect()
    assert [r.stage for r in rows] == ["Sessions", "Product View", "Add to Cart", "Checkout", "Purchase"]
    assert [r["count"] for r in rows] == [6, 3, 3, 2, 2]
    for r, e in zip(rows, [None, 0.5, 1.0, 0.666667, 1.0]):
        assert _close(r.step_conv, e)
    assert _close(rows[1].pct_of_sessions, 0.5)


def test_funnel_frame_empty_input(spark):
    empty = spark.createDataFrame([], S.CLEAN_SESSIONS)
    rows = funnel.funnel_frame(empty).orderBy("stage_order").collect()
    assert [r["count"] for r in rows] == [0] * 5
    assert all(r.step_conv is None and r.pct_of_sessions is None for r in rows)


def test_segment_funnel_tablet(spark):
    rows = funnel.funnel_frame(clean(spark), by=["device"]).where("device = 'tablet'").orderBy("stage_order").collect()
    assert [r["count"] for r in rows] == [1, 0, 0, 0, 0]
    assert [r.step_conv for r in rows] == [None, 0.0, None, None, None]


def test_windowed_equals_wide(spark):
    c = clean(spark)
    wide = funnel.funnel_frame(c, by=["device"]).select("device", "stage", "count", "pct_of_sessions", "step_conv")
    win = funnel.funnel_frame_windowed(c, by=["device"]).select("device", "stage", "count", "pct_of_sessions",
                                                                "step_conv")
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, win.collect()), key=str)


def test_biggest_leak(spark):
    r = funnel.biggest_leak(clean(spark)).collect()[0]
    assert r.stage == "Product View" and r.step_conv == 0.5


def test_biggest_leak_tie_first_wins(spark):
    # two stages share the minimum: the earlier one is reported
    rows = [("a", True, True, True, True), ("b", True, False, False, False), ("c", False, False, False, False),
            ("d", False, False, False, False)]
    df = spark.createDataFrame(rows, "session_id string, reached_product_view boolean, reached_cart boolean, "
                                     "reached_checkout boolean, purchased boolean")
    r = funnel.biggest_leak(df).collect()[0]
    assert r.stage == "Product View" and r.step_conv == 0.5


def test_channel_groups_keep_null(spark):
    rows = {r.channel: (r.sessions, r.orders) for r in funnel.channel_performance(clean(spark)).collect()}
    assert rows == {"Referral": (1, 1), "Direct": (2, 0), "Social": (2, 1), None: (1, 0)}


def test_device_tables(spark):
    c = clean(spark)
    rows = {r.device: (r.sessions, r.purchase) for r in funnel.funnel_by_segment(c).collect()}
    assert rows == {"desktop": (3, 1), "mobile": (2, 1), "tablet": (1, 0)}
    rates = funnel.segment_rates(c).collect()
    assert [r.device for r in rates] == ["mobile", "desktop", "tablet"]     # by overall desc
    assert rates[0].overall_conversion == 0.5


def test_totals_and_labels(spark):
    c = clean(spark)
    t = reports.totals(c).collect()[0]
    assert (t.total_sessions, t.total_orders) == (6, 2) and _close(t.total_revenue, 100.49, 1e-9)
    labels = [r.label for r in reports.funnel_labels(c).orderBy("stage_order").collect()]
    assert labels == ["6 (100.0%)", "3 (50.0%)", "3 (50.0%)", "2 (33.3%)", "2 (33.3%)"]
    dl = {r.device: r.label for r in reports.segment_rate_labels(c).collect()}
    assert dl == {"desktop": "33.33%", "mobile": "50.00%", "tablet": "0.00%"}


def test_label_rounding_is_half_up_and_thousands(spark):
    df = spark.createDataFrame([(71456, 150000), (1, 16), (1, 0)], "n long, d long")
    from funnelry.functions.columns import percent_label, thousands
    out = df.select(thousands("n").alias("t"), percent_label("n", "d", 1).alias("p")).collect()
    assert out[0].t == "71,456" and out[0].p == "47.6%"
    assert out[1].p == "6.3%"          # 6.25 rounds half up
    assert out[2].p is None


def test_metric_cube_equals_single_grains(spark):
    c = clean(spark)
    cube = reports.metric_cube(c)
    assert cube.count() == 1 + 3 + 4 + 5 + 3
    ch = reports.cube_grain(cube, reports.LEVEL_CHANNEL, ("channel",)).select("channel", "sessions", "orders")
    single = funnel.channel_performance(c).select("channel", "sessions", "orders")
    assert sorted(map(tuple, ch.collect()), key=str) == sorted(map(tuple, single.collect()), key=str)
    daily = reports.cube_grain(cube, reports.LEVEL_DATE, ("date",)).select("date", "sessions", "orders", "revenue")
    d2 = funnel.daily_trend(c).select("date", "sessions", "orders", "revenue")
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, d2.collect()))
    # the NULL channel group is a real group, distinct from the rolled-up rows
    nulls = cube.where("level = 5 and channel is null").collect()
    assert len(nulls) == 1 and nulls[0].sessions == 1


def test_matrix_rolls_up_to_channel_and_device(spark):
    c = clean(spark)
    m = funnel.segment_matrix(c)
    by_dev = m.groupBy("device").agg(F.sum("sessions").alias("s"), F.sum("orders").alias("o"))
    direct = funnel.funnel_by_segment(c).select("device", F.col("sessions").alias("s"), F.col("purchase").alias("o"))
    assert sorted(map(tuple, by_dev.collect())) == sorted(map(tuple, direct.collect()))


def test_worst_pockets_sql_equals_dataframe(spark):
    c = clean(spark)
    api = funnel.worst_pockets(c, k=3)
    text = sql.run(spark, sql.WORST_POCKETS, sessions=sql.sessions_view(c), k=3)
    assert [tuple(r) for r in api.collect()] == [tuple(r) for r in text.collect()]
    # ties broken by keys, NULLs last
    assert [(r.device, r.channel) for r in api.collect()] == [("desktop", "Direct"), ("desktop", None),
                                                              ("tablet", "Direct")]


def test_sql_texts_match_api(spark):
    c = clean(spark)
    v = sql.sessions_view(c)
    step = sql.run(spark, sql.STEP_CONVERSION, sessions=v).collect()[0]
    assert step.view_to_cart == 1.0 and step.overall_conversion == round(2 / 6, 4)
    union = {r.stage: r.cnt for r in sql.run(spark, sql.STAGE_UNION, sessions=v).collect()}
    stack = {r.stage: r.sessions for r in funnel.funnel_stage(c).collect()}
    assert union == stack
    dev = {r.device: r.overall_conversion for r in sql.run(spark, sql.DEVICE_RATES, sessions=v).collect()}
    api = {r.device: round(r.overall_conversion, 4) for r in funnel.segment_rates(c).collect()}
    assert dev == api


def test_decimal_trap_avoided(spark):
    # 1.0 * a / b would be DECIMAL in Spark; the texts cast to DOUBLE
    c = clean(spark)
    out = sql.run(spark, sql.STEP_CONVERSION, sessions=sql.sessions_view(c))
    assert all(t == "double" for _, t in out.dtypes)


def test_category_revenue(spark):
    from fixtures import frames
    from funnelry.operators.cleaning import purchase_lines
    s, h, _ = frames(spark)
    rows = {r.category: r for r in funnel.category_revenue(purchase_lines(h, s)).collect()}
    assert rows["Apparel"].orders == 1 and math.isclose(rows["Apparel"].avg_item_value, 55.07)
    assert rows[None].revenue == 0.0


def test_category_revenue_preaggregated_equals_lines(spark):
    from fixtures import frames
    from funnelry.operators.cleaning import purchase_lines
    s, h, p = frames(spark)
    lines = funnel.category_revenue(purchase_lines(h, s))
    pre = funnel.category_revenue_from_hits(h, p)
    assert sorted(map(tuple, lines.collect()), key=str) == sorted(map(tuple, pre.collect()), key=str)
    plan = pre._jdf.queryExecution().executedPlan().toString()
    assert plan.index("productSKU") >= 0 and "partial_count" in plan


def test_dropna_option(spark):
    c = clean(spark)
    keep = {r.channel for r in funnel.channel_performance(c).collect()}
    drop = {r.channel for r in funnel.channel_performance(c, dropna=True).collect()}
    assert None in keep and None not in drop and keep - {None} == drop
    assert funnel.segment_matrix(c, dropna=True).where("channel is null").count() == 0


def test_cube_grains_equal_device_matrix_and_stage_tables(spark):
    from funnelry.sinks.writers import dashboard_tables
    from fixtures import frames
    from funnelry.operators.cleaning import purchase_lines
    c = clean(spark)
    s, h, _ = frames(spark)
    tables = dashboard_tables(reports.metric_cube(c), purchase_lines(h, s))
    pairs = {
        "funnel_stage": funnel.funnel_stage(c),
        "funnel_by_device": funnel.funnel_by_segment(c),
        "device_channel_matrix": funnel.segment_matrix(c),
        "daily_trend": funnel.daily_trend(c),
    }
    for name, single in pairs.items():
        cube_rows = tables[name].select(*single.columns)
        assert sorted(map(tuple, cube_rows.collect()), key=str) == sorted(map(tuple, single.collect()), key=str), name
    ch = tables["channel_performance"].select("channel", "sessions", "orders", "revenue", "conversion_rate",
                                              "revenue_per_session")
    assert sorted(map(tuple, ch.collect()), key=str) == sorted(map(tuple, funnel.channel_performance(c).collect()),
                                                             key=str)
