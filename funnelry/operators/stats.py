"""Segment comparison: two-proportion z-test (M21), revenue opportunity (M22),
gap ratio (M24).

Each is one conditional aggregate over the sessions table (a single pass,
partial aggregation, one-row result); the closed-form statistics are Column
expressions on that row. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, two_sided_p
from ..spec import DEFAULT_SPEC, MICROS


def _segment_counts(sessions: DataFrame, seg: str, a: str, b: str, flag: str) -> DataFrame:
    s, f = F.col(seg), F.col(flag)
    return sessions.agg(
        F.count_if(s == a).alias("n_a"), F.count_if((s == a) & f).alias("successes_a"),
        F.count_if(s == b).alias("n_b"), F.count_if((s == b) & f).alias("successes_b"))


def ztest_columns(n_a: Column, x_a: Column, n_b: Column, x_b: Column) -> dict[str, Column]:
    """Column expressions of the pooled two-proportion z-test from four counts."""
    rate_a, rate_b = ratio(x_a, n_a), ratio(x_b, n_b)
    p_pool = ratio(x_a + x_b, n_a + n_b)
    se = F.sqrt(p_pool * (F.lit(1.0) - p_pool) * (ratio(F.lit(1.0), n_a) + ratio(F.lit(1.0), n_b)))
    z = F.try_divide(rate_a - rate_b, F.nullif(se, F.lit(0.0)))
    return {"rate_a": rate_a, "rate_b": rate_b, "p_pool": p_pool, "se": se, "z": z,
            "p_value": two_sided_p(z)}


def two_proportion_test(sessions: DataFrame, seg: str = "device", a: str = "desktop",
                        b: str = "mobile", flag: str = DEFAULT_SPEC.purchase.flag) -> DataFrame:
    """Pooled two-proportion z-test of ``flag`` between segments a and b.

    rate_a, rate_b, p_pool, se, z and the two-sided p-value (upper-tail form,
    no cancellation). Empty segments or SE = 0 give NULL instead of an error.
    """
    c = _segment_counts(sessions, seg, a, b, flag)
    cols = ztest_columns(F.col("n_a"), F.col("successes_a"), F.col("n_b"), F.col("successes_b"))
    return c.select(F.lit(seg).alias("segment"), F.lit(a).alias("group_a"), F.lit(b).alias("group_b"),
                    "n_a", "successes_a", "n_b", "successes_b",
                    *[v.alias(k) for k, v in cols.items()])


def gap_opportunity(sessions: DataFrame, seg: str = "device", hi: str = "desktop", lo: str = "mobile",
                    share: float = 0.5, periods_per_year: float = 12 / 3,
                    flag: str = DEFAULT_SPEC.purchase.flag) -> DataFrame:
    """Extra orders and revenue if segment ``lo`` closed ``share`` of its gap to ``hi``.

    aov = mean revenue of sessions with ``flag``; extra orders =
    (target - rate_lo) * sessions_lo with target = rate_lo + share * (rate_hi - rate_lo);
    annualised = per-period revenue * periods_per_year (data covers one period).
    """
    s, f = F.col(seg), F.col(flag)
    c = sessions.agg(
        F.count_if(s == hi).alias("n_hi"), F.count_if((s == hi) & f).alias("x_hi"),
        F.count_if(s == lo).alias("n_lo"), F.count_if((s == lo) & f).alias("x_lo"),
        F.count_if(f).alias("buyers"),
        F.sum(F.when(f, F.coalesce(F.col("revenue_micros"), F.lit(0)))).alias("buyer_micros"))
    cols = opportunity_columns(F.col("n_hi"), F.col("x_hi"), F.col("n_lo"), F.col("x_lo"),
                               F.col("buyers"), F.col("buyer_micros"), share, periods_per_year)
    return c.select(F.lit(hi).alias("segment_hi"), F.lit(lo).alias("segment_lo"),
                    *[v.alias(k) for k, v in cols.items()])


def opportunity_columns(n_hi: Column, x_hi: Column, n_lo: Column, x_lo: Column, buyers: Column,
                        buyer_micros: Column, share: float = 0.5,
                        periods_per_year: float = 12 / 3) -> dict[str, Column]:
    """Column expressions of the half-gap opportunity from segment counts."""
    rate_hi, rate_lo = ratio(x_hi, n_hi), ratio(x_lo, n_lo)
    aov_ = ratio(buyer_micros, buyers) / MICROS
    target = rate_lo + F.lit(float(share)) * (rate_hi - rate_lo)
    extra = (target - rate_lo) * n_lo
    period = extra * aov_
    return {"aov": aov_, "rate_hi": rate_hi, "rate_lo": rate_lo, "target_rate": target,
            "extra_orders_period": extra, "extra_revenue_period": period,
            "extra_revenue_annualized": period * F.lit(float(periods_per_year))}


def gap_ratio(sessions: DataFrame, seg: str = "device", a: str = "desktop", b: str = "mobile",
              flag: str = DEFAULT_SPEC.purchase.flag) -> DataFrame:
    """rate_a, rate_b and rate_a / rate_b (NULL when rate_b is 0)."""
    c = _segment_counts(sessions, seg, a, b, flag)
    r = c.select(ratio("successes_a", "n_a").alias("rate_a"), ratio("successes_b", "n_b").alias("rate_b"))
    return r.select(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "rate_a", "rate_b",
                    F.try_divide(F.col("rate_a"), F.nullif(F.col("rate_b"), F.lit(0.0))).alias("ratio"))


def aov(sessions: DataFrame, flag: str = DEFAULT_SPEC.purchase.flag) -> DataFrame:
    """Mean revenue over sessions with ``flag`` (orders, revenue, aov)."""
    f = F.col(flag)
    c = sessions.agg(F.count_if(f).alias("orders"),
                     F.coalesce(F.sum(F.when(f, F.coalesce(F.col("revenue_micros"), F.lit(0)))), F.lit(0))
                     .alias("_m"))
    return c.select("orders", (F.col("_m").cast("double") / MICROS).alias("revenue"),
                    (ratio("_m", "orders") / MICROS).alias("aov"))
