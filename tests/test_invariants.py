"""Cross-path invariants: API vs SQL text, flat vs nested."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL

Q = entry.queries()


def rows(df, cols=None):
    df = df.select(*(cols or sorted(df.columns)))
    return sorted((tuple(r) for r in df.collect()), key=str)


def rounded(df, spec: dict):
    return df.select(*[F.round(c, spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns])


def test_device_rates_sql_equals_rounded_api(spark):
    api = rounded(Q["device_rates"](spark, SF_SMALL), {c: 4 for c in ("view_to_cart", "cart_to_checkout",
                                                                      "checkout_to_purchase", "overall_conversion")})
    assert rows(api) == rows(Q["device_rates_sql"](spark, SF_SMALL))


def test_channel_sql_equals_rounded_api(spark):
    api = rounded(Q["channel_performance"](spark, SF_SMALL),
                  {"conversion_rate": 4, "revenue": 2, "revenue_per_session": 3})
    assert rows(api) == rows(Q["channel_performance_sql"](spark, SF_SMALL))


def test_category_sql_equals_rounded_api(spark):
    api = rounded(Q["category_revenue_lines"](spark, SF_SMALL), {"revenue": 2, "avg_item_value": 2})
    assert rows(api) == rows(Q["category_revenue_sql"](spark, SF_SMALL))
    assert rows(Q["category_revenue"](spark, SF_SMALL)) == rows(Q["category_revenue_lines"](spark, SF_SMALL))


def test_daily_head_is_first_days_of_trend(spark):
    full = rounded(Q["daily_trend"](spark, SF_SMALL), {"conversion_rate": 4, "revenue": 2})
    head = Q["daily_trend_head"](spark, SF_SMALL)
    first = full.orderBy("date").limit(15)
    assert rows(head) == rows(first, sorted(head.columns))


def test_nested_paths_equal_flat_paths(spark):
    assert rows(Q["nested_device"](spark, SF_SMALL)) == rows(Q["device_rates_sql"](spark, SF_SMALL))
    assert rows(Q["nested_channel"](spark, SF_SMALL)) == rows(Q["channel_performance_sql"](spark, SF_SMALL))
    flat = rounded(Q["device_channel_matrix"](spark, SF_SMALL), {"conversion_rate": 4}).drop("orders")
    assert rows(Q["nested_matrix"](spark, SF_SMALL)) == rows(flat)
    n = Q["nested_funnel"](spark, SF_SMALL).first()
    stages = {r.stage: r.cnt for r in Q["union_stages"](spark, SF_SMALL).collect()}
    assert (n.sessions, n.product_views, n.add_to_carts, n.checkouts, n.purchases) == (
        stages["Sessions"], stages["Product View"], stages["Add to Cart"], stages["Checkout"], stages["Purchase"])


def test_findings_agree_with_single_queries(spark):
    doc = Q["findings"](spark, SF_SMALL).first()
    sc = Q["findings_scalars"](spark, SF_SMALL).first()
    z = Q["device_ztest"](spark, SF_SMALL).first()
    assert (doc.desktop_vs_mobile.z, sc.z) == (z.z, z.z)
    leak = Q["biggest_leak"](spark, SF_SMALL).first()
    assert (doc.biggest_leak_stage, doc.biggest_leak_step_conv) == (leak.stage, leak.step_conv)
    dev = {r.device: r.overall_conversion for r in Q["device_rates"](spark, SF_SMALL).collect()}
    assert {r.device: r.overall_conv for r in doc.by_device} == dev
