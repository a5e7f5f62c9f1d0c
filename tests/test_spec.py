"""Stages are parameters: a custom funnel flows through every operator."""

from fixtures import frames
from funnelry.operators import cleaning, funnel, reports, stats
from funnelry.plans import sql
from funnelry.spec import FunnelSpec, Stage

# three-stage funnel, purchase taken from purchase hits instead of transactions
SPEC = FunnelSpec(
    stages=(Stage("Viewed", "viewed", 2, "product_view"),
            Stage("Checked out", "checked_out", 5, "checkout"),
            Stage("Bought", "bought", 6, "purchase", from_hits=True)),
    entry_label="Visits", count_names=("viewed", "checked_out", "bought"),
    step_names=("view", "checkout", "buy"))


def test_custom_spec_end_to_end(spark):
    s, h, _ = frames(spark)
    c = cleaning.clean_sessions(s, h, SPEC)
    assert c.columns[7:10] == ["viewed", "checked_out", "bought"]
    rows = funnel.funnel_frame(c, SPEC).orderBy("stage_order").collect()
    assert [r.stage for r in rows] == ["Visits", "Viewed", "Checked out", "Bought"]
    # s1 has a purchase hit; s4 purchased by transactions but has no purchase hit
    assert [r["count"] for r in rows] == [6, 3, 2, 1]
    rates = funnel.segment_rates(c, "device", SPEC)
    assert rates.columns == ["device", "sessions", "view_to_checkout", "checkout_to_buy", "overall_conversion"]
    cube = reports.metric_cube(c, SPEC)
    assert {"viewed", "checked_out", "orders"} <= set(cube.columns)
    z = stats.two_proportion_test(c, flag="bought").first()
    assert (z.successes_a, z.successes_b) == (1, 0)
    doc = reports.findings(c, SPEC).first()
    assert [r.stage for r in doc.overall_funnel] == ["Visits", "Viewed", "Checked out", "Bought"]
    assert set(doc.by_device[0].asDict()) == {"device", "sessions", "view_to_checkout", "checkout_to_buy",
                                              "overall_conv"}


def test_sql_texts_follow_another_spec(spark):
    s, h, _ = frames(spark)
    view = sql.sessions_view(cleaning.clean_sessions(s, h, SPEC), SPEC)
    union = {r.stage: r.cnt for r in sql.run(spark, sql.stage_union(SPEC), view).collect()}
    assert union == {"Visits": 6, "Viewed": 3, "Checked out": 2, "Bought": 1}
    steps = sql.run(spark, sql.step_conversion(SPEC), view).first()
    assert steps.asDict() == {"session_to_view": 0.5, "view_to_checkout": 0.6667, "checkout_to_buy": 0.5, "overall_conversion": 0.1667}
    rates = sql.run(spark, sql.segment_rates("device", SPEC), view)
    assert rates.columns == ["device", "sessions", "view_to_checkout", "checkout_to_buy", "overall_conversion"]
    clean = cleaning.clean_sessions(s, h, SPEC)
    want = {r.device: (r.sessions, r.overall_conversion) for r in funnel.segment_rates(clean, "device", SPEC).collect()}
    assert {r.device: r.sessions for r in rates.collect()} == {d: n for d, (n, _) in want.items()}
    totals = sql.run(spark, sql.stage_totals(SPEC, ("views", "checkouts", "buys")), view).first()
    assert (totals.sessions, totals.views, totals.checkouts, totals.buys) == (6, 3, 2, 1)
    perf = sql.run(spark, sql.segment_performance(("device",), SPEC), view).collect()
    assert sum(r.orders for r in perf) == 1
