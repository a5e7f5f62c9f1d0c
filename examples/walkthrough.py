"""Walk through the headline analysis on a test-data directory.

    python examples/walkthrough.py /root/testdata/sf0.01

Everything is computed as Spark DataFrames; only the small final results
(a handful of rows each) are collected here for display.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from funnelry.api import FunnelAnalysis  # noqa: E402
from funnelry.session import get_spark  # noqa: E402
from funnelry.sources import testdata  # noqa: E402


def main(sf_dir: str) -> None:
    spark = get_spark()
    m = testdata.load(spark, sf_dir)
    # clean sessions from the fused rollup (totals and flags in one pass)
    fa = FunnelAnalysis.from_clean(m.sessions(), m.raw_sessions(), m.hits(), m.products())

    print("== funnel ==")
    fa.funnel().orderBy("stage_order").show()
    leak = fa.biggest_leak().first()
    print(f"biggest leak: {leak.stage} ({leak.step_conv:.1%} advance)")
    print("== by device ==")
    fa.rates("device").show()
    print("== by channel ==")
    fa.performance("channel").show()
    z = fa.ztest("device", "desktop", "mobile").first()
    print(f"desktop {z.rate_a:.3%} vs mobile {z.rate_b:.3%}: z={z.z:.2f} p={z.p_value:.3g}")
    o = fa.opportunity().first()
    print(f"AOV {o.aov:,.2f}; closing half the gap: {o.extra_orders_period:,.1f} orders, "
          f"{o.extra_revenue_period:,.0f} per period, {o.extra_revenue_annualized:,.0f} per year")
    print("== worst pockets ==")
    fa.worst_pockets(5).show()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
