"""The expected values published in FIXTURES.md section 4 (test tables)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_MID, SF_SMALL
from funnelry.sources import testdata

STAGES = {SF_SMALL: (397, 153, 165, 156, 159, 10424.69), SF_MID: (4006, 1617, 1601, 1611, 1604, 95455.77)}
DEVICES = {
    SF_SMALL: {"desktop": (315, 121, 134, 127, 118, 8005.48), "mobile": (56, 23, 22, 21, 26, 1166.49),
               "tablet": (26, 9, 9, 8, 15, 1252.72)},
    SF_MID: {"desktop": (2796, 1163, 1094, 1119, 1100, 65790.93), "mobile": (808, 301, 349, 315, 319, 19599.05),
             "tablet": (402, 153, 158, 177, 185, 10065.79)},
}
CODES = {SF_SMALL: [201, 188, 210, 199, 202], SF_MID: [2014, 1982, 2006, 2017, 1981]}
NO_MAPPED_HIT = {SF_SMALL: 31, SF_MID: 295}
ZTEST = {SF_SMALL: (-1.268966, 0.204453), SF_MID: (-0.070862, 0.943508)}
CELLS = {SF_SMALL: 7, SF_MID: 14}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_stage_counts_and_revenue(spark, sf):
    t = entry.queries()["funnel_by_device"](spark, sf)
    rows = {r.device: (r.sessions, r.product_view, r.cart, r.checkout, r.purchase, round(r.revenue, 2))
            for r in t.collect()}
    assert rows == DEVICES[sf]
    s = testdata.load(spark, sf).sessions()
    agg = s.agg(F.count(F.lit(1)), *[F.sum(F.col(c).cast("int")) for c in
                                    ("reached_product_view", "reached_cart", "reached_checkout", "purchased")],
                F.sum("revenue")).first()
    assert tuple(agg[:5]) == STAGES[sf][:5] and round(agg[5], 2) == STAGES[sf][5]


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_codes_unmapped_sessions_cells_and_ztest(spark, sf):
    codes = [r.hits for r in entry.queries()["action_counts"](spark, sf).collect()]
    assert codes == CODES[sf]
    assert entry.queries()["sessions_without_hits"](spark, sf).count() == NO_MAPPED_HIT[sf]
    assert entry.queries()["device_channel_matrix"](spark, sf).count() == CELLS[sf]
    z = entry.queries()["device_ztest"](spark, sf).first()
    assert (round(z.z, 6), round(z.p_value, 6)) == ZTEST[sf]


def test_mid_scale_details(spark):
    s = testdata.load(spark, SF_MID).sessions()
    assert s.where("revenue_micros is null").count() == 2402
    assert entry.queries()["hit_sequence"](spark, SF_MID).agg(F.max("hitNumber")).first()[0] == 10
    ch = {r.channel: (r.sessions, r.orders) for r in entry.queries()["channel_performance"](spark, SF_MID).collect()}
    assert ch == {"AUTOMOBILE": (702, 268), "BUILDING": (930, 368), "FURNITURE": (744, 306),
                  "HOUSEHOLD": (920, 390), "MACHINERY": (710, 272)}
    cat = {r.category: r.orders for r in entry.queries()["category_revenue"](spark, SF_MID).collect()}
    assert cat == {"ECONOMY": 299, "LARGE": 333, "MEDIUM": 416, "PROMO": 338, "SMALL": 264, "STANDARD": 331}
    assert entry.queries()["metric_cube"](spark, SF_MID).count() == 53
