import math
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from fixtures import clean
from funnelry import schema as S
from funnelry.functions.columns import erfc_col, two_sided_p
from funnelry.operators import reports, stats


def test_ztest_fixture(spark):
    r = stats.two_proportion_test(clean(spark)).collect()[0]
    assert (r.n_a, r.successes_a, r.n_b, r.successes_b) == (3, 1, 2, 1)
    assert r.z == pytest.approx(-0.372678, abs=1e-6)
    assert r.p_value == pytest.approx(0.709388, abs=1e-6)


def _exact_erfc(x: Decimal) -> Decimal:
    """erfc to 40 digits: the series of erf in enough digits to bear the cancellation."""
    with localcontext() as c:
        c.prec = 700
        term = total = x
        n = 0
        while abs(term) > Decimal(10) ** -690:
            n += 1
            term = -term * x * x / n
            total += term / (2 * n + 1)
        return 1 - 2 * total / _PI.sqrt()


#: pi to 100 digits are not enough for large x, so it is summed here (Machin).
def _pi() -> Decimal:
    with localcontext() as c:
        c.prec = 710
        arctan = lambda n: sum((Decimal((-1) ** k) / ((2 * k + 1) * Decimal(n) ** (2 * k + 1)) for k in range(520)), Decimal(0))
        return 4 * (4 * arctan(5) - arctan(239))


_PI = _pi()


def test_erfc_and_p_value_in_full_precision(spark):
    xs = [0.0, 1e-300, 1e-9, 0.01, *[i / 8 for i in range(1, 208)], 1.7677669529, 1.767766952966369, 1.76776695297]
    got = [r.e for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc_col(F.col("x")).alias("e")).collect()]
    for x, e in zip(xs, got):
        want = _exact_erfc(Decimal(x))
        assert abs(Decimal(e) - want) <= Decimal("1e-13") * want, x
        assert math.isclose(e, math.erfc(x), rel_tol=1e-13)
    zs = [0.0, 1e-12, *[i / 4 for i in range(1, 150)], 2.4999999, 2.5, 2.5000001]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided_p(F.col("z")).alias("p")).collect()]
    for z, p in zip(zs, got):
        with localcontext() as c:
            c.prec = 60
            want = _exact_erfc(Decimal(z) / Decimal(2).sqrt())
        assert abs(Decimal(p) - want) <= Decimal("1e-13") * want, z


def test_p_value_of_odd_z(spark):
    zs = [float("inf"), float("-inf"), 38.6, 64.0, 1e200, -3.0, float("nan"), None]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided_p(F.col("z")).alias("p")).collect()]
    assert got[0] == got[1] == got[3] == got[4] == 0.0 and 0 <= got[2] < 1e-300 and got[7] is None and math.isnan(got[6])
    assert math.isclose(got[5], math.erfc(3 / math.sqrt(2)), rel_tol=1e-13)


def test_p_value_tail_does_not_cancel(spark):
    df = spark.createDataFrame([(19.278537,), (0.0,), (-1.959964,), (None,)], "z double")
    p = [r.p for r in df.select(two_sided_p(F.col("z")).alias("p")).collect()]
    assert p[0] == pytest.approx(math.erfc(19.278537 / math.sqrt(2)), rel=1e-13)
    assert 8.0e-83 < p[0] < 8.3e-83            # not 0.0 as 2*(1-cdf) would give
    assert p[1] == 1.0                           # capped at 1
    assert p[2] == pytest.approx(0.05, abs=1e-6)
    assert p[3] is None


def test_ztest_empty_segment_is_null(spark):
    r = stats.two_proportion_test(clean(spark), "device", "desktop", "watch").collect()[0]
    assert r.n_b == 0 and r.rate_b is None and r.z is None and r.p_value is None


def test_ztest_zero_se_is_null(spark):
    rows = [("a", "x", False), ("b", "y", False)]
    df = spark.createDataFrame(rows, "session_id string, device string, purchased boolean")
    r = stats.two_proportion_test(df, "device", "x", "y").collect()[0]
    assert r.se == 0.0 and r.z is None


def test_gap_opportunity_fixture(spark):
    r = stats.gap_opportunity(clean(spark)).collect()[0]
    assert r.aov == pytest.approx(50.245)
    assert r.extra_orders_period == pytest.approx(-0.166667, abs=1e-6)
    assert r.extra_revenue_period == pytest.approx(-8.374167, abs=1e-6)
    assert r.extra_revenue_annualized == pytest.approx(-33.496667, abs=1e-6)


def test_gap_ratio_and_aov(spark):
    c = clean(spark)
    g = stats.gap_ratio(c, "device", "mobile", "desktop").collect()[0]
    assert g.ratio == pytest.approx(1.5)
    z = stats.gap_ratio(c, "device", "desktop", "tablet").collect()[0]
    assert z.rate_b == 0.0 and z.ratio is None
    a = stats.aov(c).collect()[0]
    assert a.orders == 2 and a.aov == pytest.approx(50.245)


def test_findings_document(spark):
    doc = reports.findings(clean(spark)).collect()[0]
    assert doc.total_sessions == 6 and doc.total_orders == 2
    assert doc.biggest_leak_stage == "Product View" and doc.biggest_leak_step_conv == 0.5
    assert [r.stage for r in doc.overall_funnel] == ["Sessions", "Product View", "Add to Cart", "Checkout",
                                                     "Purchase"]
    assert doc.overall_funnel[0].step_conv is None
    assert [r.device for r in doc.by_device] == ["mobile", "desktop", "tablet"]
    assert doc.by_channel[0].channel == "Referral"
    assert doc.desktop_vs_mobile.z == pytest.approx(-0.372678, abs=1e-6)
    assert doc.recovery_extra_revenue_annualized == pytest.approx(-33.496667, abs=1e-6)


def test_findings_empty_input(spark):
    empty = spark.createDataFrame([], S.CLEAN_SESSIONS)
    doc = reports.findings(empty).collect()[0]
    assert doc.total_sessions == 0 and doc.overall_conversion is None
    assert doc.by_device == [] and doc.biggest_leak_stage is None
