from pyspark.sql import functions as F

from fixtures import clean, frames
from funnelry.operators import cleaning


def _flags(df):
    rows = df.orderBy("session_id").collect()
    return {r.session_id: "".join(str(int(r[f])) for f in
                                  ["reached_product_view", "reached_cart", "reached_checkout", "purchased"])
            for r in rows}


def test_flags_open_funnel(spark):
    assert _flags(clean(spark)) == {"s1": "1111", "s2": "1100", "s3": "0100", "s4": "1011",
                                    "s5": "0000", "s6": "0000"}


def test_clean_schema_and_revenue(spark):
    df = clean(spark)
    assert df.columns == ["session_id", "fullVisitorId", "date", "channel", "device", "country", "pageviews",
                          "reached_product_view", "reached_cart", "reached_checkout", "purchased", "revenue",
                          "revenue_micros"]
    assert dict(df.dtypes)["date"] == "date"
    r = {x.session_id: x for x in df.collect()}
    assert r["s1"].revenue == 89.99 and r["s4"].revenue == 10.5 and r["s2"].revenue == 0.0
    assert r["s2"].revenue_micros is None            # null micros kept, revenue 0
    assert r["s3"].purchased is False                 # NULL transactions counts as 0


def test_fused_rollup_equals_join_path(spark):
    _, h, _ = frames(spark)
    rolled = cleaning.session_rollup(h.where(F.col("session_id") != "s9"), with_flags=True)
    joined = cleaning.stage_flags(h.where(F.col("session_id") != "s9"))
    a = sorted(tuple(r) for r in rolled.select("session_id", "reached_product_view", "reached_cart",
                                               "reached_checkout").collect())
    b = sorted(tuple(r) for r in joined.collect())
    assert a == b


def test_session_rollup_totals(spark):
    _, h, _ = frames(spark)
    h = h.withColumn("value", F.col("productPrice"))
    r = {x.session_id: x for x in cleaning.session_rollup(h, value_col="value").collect()}
    assert r["s1"].totals_hits == 5 and r["s1"].totals_pageviews == 1        # hits + 1, code-2 hits
    assert r["s1"].totals_transactions == 1 and r["s1"].totals_transactionRevenue == 55070000
    assert r["s2"].totals_transactionRevenue is None
    assert r["s3"].totals_bounces == 1 and r["s2"].totals_bounces == 0


def test_quality_report(spark):
    s, h, _ = frames(spark)
    q = cleaning.quality_report(s, h).collect()[0]
    assert (q.sessions, q.hits, q.duplicate_session_ids, q.sessions_without_hits) == (6, 12, 0, 1)


def test_quality_report_duplicates_and_null_keys(spark):
    s, h, _ = frames(spark)
    dup = s.unionByName(s.where("session_id = 's1'"))
    nul = dup.unionByName(s.where("session_id = 's5'").withColumn("session_id", F.lit(None).cast("string")))
    nul = nul.unionByName(s.where("session_id = 's5'").withColumn("session_id", F.lit(None).cast("string")))
    q = cleaning.quality_report(nul, h).collect()[0]
    assert q.duplicate_session_ids == 2            # one extra s1 + second NULL key
    assert q.sessions_without_hits == 3            # s5 + both NULL-key rows
    d = cleaning.duplicate_keys(nul).collect()[0]
    assert (d.rows, d.distinct_keys, d.duplicate_rows) == (9, 7, 2)


def test_sessions_without_hits_anti_join(spark):
    s, h, _ = frames(spark)
    assert [r.session_id for r in cleaning.sessions_without_hits(s, h).collect()] == ["s5"]


def test_purchase_lines(spark):
    s, h, _ = frames(spark)
    rows = {r.session_id: r for r in cleaning.purchase_lines(h, s).collect()}
    assert set(rows) == {"s1", "s9"}                   # s4 purchased but has no code-6 hit
    assert rows["s1"].item_value == 55.07 and rows["s1"].category == "Apparel"
    assert rows["s9"].item_value == 0.0 and rows["s9"].channel is None and rows["s9"].date is None


def test_event_log(spark):
    s, h, _ = frames(spark)
    ev = cleaning.event_log(h, s)
    rows = ev.collect()
    assert len(rows) == 11                              # code 0 dropped
    s9 = [r for r in rows if r.session_id == "s9"][0]
    assert s9.event_type == "purchase" and s9.device is None and s9.event_date is None
    assert {r.event_type for r in rows} == {"product_view", "add_to_cart", "checkout", "purchase"}


def test_stage_sets_and_action_counts(spark):
    _, h, _ = frames(spark)
    sets = {r.session_id: r.stages for r in cleaning.stage_sets(h).collect()}
    assert sets["s1"] == ["add_to_cart", "checkout", "product_view", "purchase"]
    assert "s6" not in sets                             # only unmapped hits
    counts = [(r.eCommerceAction_action_type, r.hits) for r in cleaning.action_counts(h).collect()]
    assert counts == [(0, 1), (2, 4), (3, 3), (5, 2), (6, 2)]


def test_attach_products_defaults(spark):
    _, h, p = frames(spark)
    j = cleaning.attach_products(h.drop("v2ProductCategory", "productPrice"), p)
    z = j.where("productSKU = 'Z'").collect()[0]
    assert z.productPrice == 0.0 and z.v2ProductCategory is None
    a = j.where("productSKU = 'A'").select("productPrice").distinct().collect()
    assert [r.productPrice for r in a] == [55.07]


def test_pipeline_summary(spark):
    s, h, _ = frames(spark)
    c = cleaning.clean_sessions(s, h)
    out = cleaning.pipeline_summary(c, cleaning.purchase_lines(h, s), cleaning.event_log(h, s)).collect()[0]
    assert (out.sessions_rows, out.purchases_rows, out.events_rows) == (6, 2, 11)
    assert abs(out.overall_conversion - 2 / 6) < 1e-12 and abs(out.total_revenue - 100.49) < 1e-9


def test_clean_sessions_reads_processed_date(spark):
    c = clean(spark)
    # already-typed input (date column is DATE) passes through unchanged
    raw_like = c.select("session_id", "fullVisitorId", "date", F.col("channel").alias("channelGrouping"),
                        F.col("device").alias("deviceCategory"), "country",
                        F.col("pageviews").alias("totals_pageviews"),
                        F.col("purchased").cast("int").alias("totals_transactions"),
                        F.col("revenue_micros").alias("totals_transactionRevenue"),
                        "reached_product_view", "reached_cart", "reached_checkout")
    again = cleaning.clean_sessions(raw_like)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, c.collect()))


def test_dedupe_sessions_opt_in(spark):
    s, h, _ = frames(spark)
    later = s.where("session_id = 's1'").withColumn("visitId", F.lit(99).cast("long")) \
             .withColumn("channelGrouping", F.lit("Display"))
    dup = s.unionByName(later)
    d = cleaning.dedupe_sessions(dup)
    assert d.count() == 6 and d.columns == s.columns
    assert d.where("session_id = 's1'").first().channelGrouping == "Referral"   # smallest visitId kept
    assert cleaning.quality_report(d, h).first().duplicate_session_ids == 0
