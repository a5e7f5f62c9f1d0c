"""Funnel and segment metrics over the clean sessions table.

Pattern: one aggregation per grain (partial aggregation map-side, a shuffle of
at most one row per group per task), ratios computed on the aggregated row,
then ``inline`` to turn a wide row into stage rows. No Python, no collect,
no unpartitioned window over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag_count, ratio, sum_micros, usd_to_micros
from ..spec import DEFAULT_SPEC, MICROS, FunnelSpec
from .cleaning import unique_products


def _counts(spec: FunnelSpec) -> list[Column]:
    """c0 = sessions (those with an id), c1..cn = sessions reaching each stage."""
    return [F.count("session_id").alias("c0")] + [flag_count(f).alias(f"c{i + 1}")
                                              for i, f in enumerate(spec.flags)]


def stage_counts(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                 by: Sequence[str] = ()) -> DataFrame:
    """Wide row per segment: c0 (sessions) .. cn (last stage)."""
    g = sessions.groupBy(*by) if by else sessions.groupBy()
    return g.agg(*_counts(spec))


def _stage_structs(spec: FunnelSpec) -> Column:
    n = len(spec.flags)
    rows = []
    for i, label in enumerate(spec.labels):
        c = F.col(f"c{i}")
        step = F.lit(None).cast("double") if i == 0 else ratio(c, F.col(f"c{i - 1}"))
        rows.append(F.struct(F.lit(label).alias("stage"), F.lit(i).alias("stage_order"),
                             c.alias("count"), ratio(c, "c0").alias("pct_of_sessions"),
                             step.alias("step_conv")))
    assert len(rows) == n + 1
    return F.array(*rows)


# --- M8: funnel frame ---------------------------------------------------------
def funnel_frame(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                 by: Sequence[str] = ()) -> DataFrame:
    """stage, stage_order, count, pct_of_sessions, step_conv (per segment).

    step_conv = count / previous stage count, NULL for the first stage or a
    zero previous count; empty input gives zero counts and NULL ratios.
    """
    wide = stage_counts(sessions, spec, by)
    return wide.select(*by, F.inline(_stage_structs(spec)))


# --- W1 / W2: window form over a long stage table -----------------------------
def step_ratios(long_counts: DataFrame, by: Sequence[str], count_col: str = "count",
                order_col: str = "stage_order") -> DataFrame:
    """Add pct_of_sessions (count / first stage) and step_conv (count / previous).

    Windows are partitioned by the segment columns and run over aggregated
    stage rows only (stages x segments), never over raw rows.
    """
    if not by:
        raise ValueError("step_ratios needs segment columns; funnel_frame gives the ratios of a whole table")
    w = Window.partitionBy(*by).orderBy(order_col)
    first = F.first(F.col(count_col)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prev = F.lag(F.col(count_col)).over(w)
    return long_counts.select("*", ratio(count_col, first).alias("pct_of_sessions"),
                              ratio(count_col, prev).alias("step_conv"))


def funnel_frame_windowed(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                          by: Sequence[str] = ("device",)) -> DataFrame:
    """M8 per segment through the window form: agg -> stack -> lag / first."""
    long = funnel_stage(sessions, spec, by=by).withColumnRenamed("sessions", "count")
    return step_ratios(long, by)


# --- M9 / U1: long stage counts -----------------------------------------------
def funnel_stage(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                 by: Sequence[str] = ()) -> DataFrame:
    """stage, sessions, stage_order: one aggregate + stack (one scan, not n)."""
    wide = stage_counts(sessions, spec, by)
    rows = F.array(*[F.struct(F.lit(label).alias("stage"), F.col(f"c{i}").alias("sessions"),
                              F.lit(i).alias("stage_order"))
                     for i, label in enumerate(spec.labels)])
    return wide.select(*by, F.inline(rows))


# --- M12: device (segment) step rates -----------------------------------------
def segment_rates(sessions: DataFrame, by: str = "device",
                  spec: FunnelSpec = DEFAULT_SPEC, dropna: bool = False) -> DataFrame:
    """segment, sessions, each step rate after the first stage, overall_conversion."""
    wide = stage_counts(drop_null_keys(sessions, [by], dropna), spec, [by])
    names = [f"{a}_to_{b}" for a, b in zip(spec.step_names[:-1], spec.step_names[1:])]
    n = len(spec.flags)
    steps = [ratio(f"c{i + 1}", f"c{i}").alias(names[i - 1]) for i in range(1, n)]
    overall = ratio(f"c{n}", "c0")
    return (wide.select(by, F.col("c0").alias("sessions"), *steps, overall.alias("overall_conversion"))
                .orderBy(F.desc_nulls_last("overall_conversion"), F.asc_nulls_last(by)))


# --- M13: per-device counts ---------------------------------------------------
def funnel_by_segment(sessions: DataFrame, by: str = "device",
                      spec: FunnelSpec = DEFAULT_SPEC, dropna: bool = False) -> DataFrame:
    """segment, sessions, product_view, cart, checkout, purchase, revenue."""
    aggs = [F.count("session_id").alias("sessions")]
    aggs += [flag_count(f).alias(n) for f, n in zip(spec.flags, spec.count_names)]
    aggs += [(sum_micros("revenue_micros").cast("double") / MICROS).alias("revenue")]
    return drop_null_keys(sessions, [by], dropna).groupBy(by).agg(*aggs).orderBy(F.asc_nulls_last(by))


# --- M14 / M15 / M17: sessions, orders, revenue per grain ---------------------
def drop_null_keys(df: DataFrame, keys: Sequence[str], dropna: bool) -> DataFrame:
    """pandas-style grouping drops NULL keys; SQL (the default here) keeps them."""
    if not dropna:
        return df
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def _performance(sessions: DataFrame, keys: Sequence[str], spec: FunnelSpec,
                 keep_micros: bool = False, dropna: bool = False) -> DataFrame:
    agg = drop_null_keys(sessions, keys, dropna).groupBy(*keys).agg(
        F.count("session_id").alias("sessions"),
        flag_count(spec.purchase.flag).alias("orders"),
        sum_micros("revenue_micros").alias("revenue_micros"))
    cols = [*keys, "sessions", "orders",
            (F.col("revenue_micros").cast("double") / MICROS).alias("revenue"),
            ratio("orders", "sessions").alias("conversion_rate"),
            ratio(F.col("revenue_micros").cast("double") / MICROS, "sessions").alias("revenue_per_session")]
    if keep_micros:
        cols.append("revenue_micros")
    return agg.select(*cols)


def channel_performance(sessions: DataFrame, by: str = "channel",
                        spec: FunnelSpec = DEFAULT_SPEC, keep_micros: bool = False,
                        dropna: bool = False) -> DataFrame:
    """channel, sessions, orders, revenue, conversion_rate, revenue_per_session."""
    return (_performance(sessions, [by], spec, keep_micros, dropna)
            .orderBy(F.desc_nulls_last("conversion_rate"), F.asc_nulls_last(by)))


def segment_matrix(sessions: DataFrame, rows: str = "device", cols: str = "channel",
                   spec: FunnelSpec = DEFAULT_SPEC, dropna: bool = False) -> DataFrame:
    """device, channel, sessions, orders, conversion_rate (present cells only)."""
    return (_performance(sessions, [rows, cols], spec, dropna=dropna)
            .select(rows, cols, "sessions", "orders", "conversion_rate")
            .orderBy(F.asc_nulls_last(rows), F.asc_nulls_last(cols)))


def worst_pockets(sessions: DataFrame, k: int = 10, rows: str = "device", cols: str = "channel",
                  spec: FunnelSpec = DEFAULT_SPEC, decimals: int = 4) -> DataFrame:
    """Bottom-k cells by conversion (the report's feature is the top-k).

    Sorted on the unrounded rate, then the keys (NULLs last), so ties at the
    cut are deterministic; planned as TakeOrderedAndProject (per-task top-k,
    no global sort).
    """
    m = _performance(sessions, [rows, cols], spec)
    return (m.orderBy(F.asc_nulls_last("conversion_rate"), F.asc_nulls_last(rows), F.asc_nulls_last(cols))
             .limit(k)
             .select(rows, cols, "sessions", F.round("conversion_rate", decimals).alias("conversion_rate")))


def daily_trend(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                by: Sequence[str] = (), dropna: bool = False) -> DataFrame:
    """date, sessions, orders, revenue, conversion_rate; optional extra keys
    (e.g. device or channel, for slicing the trend)."""
    return (_performance(sessions, ["date", *by], spec, dropna=dropna)
            .select("date", *by, "sessions", "orders", "revenue", "conversion_rate")
            .orderBy("date", *by))


# --- M19: category revenue ----------------------------------------------------
def category_revenue(purchases: DataFrame, by: str = "category") -> DataFrame:
    """category, orders, revenue, avg_item_value; by revenue descending.

    Money is summed as integer micros (exact, order-independent); the average
    is over non-NULL item values, as SQL AVG.
    """
    m = usd_to_micros("item_value")
    agg = purchases.groupBy(by).agg(F.count("session_id").alias("orders"),
                                    sum_micros(m).alias("_micros"),
                                    F.count("item_value").alias("_n"))
    return (agg.select(by, "orders", (F.col("_micros").cast("double") / MICROS).alias("revenue"),
                       (ratio("_micros", "_n") / MICROS).alias("avg_item_value"))
               .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last(by)))


def category_revenue_from_hits(hits: DataFrame, products: DataFrame, by: str = "category",
                               spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """M19 computed from purchase hits without shuffling purchase lines.

    Purchase hits are first reduced per SKU (map-side combine: at most one
    row per SKU per task), the small per-SKU table is joined to the product
    dimension, and only then grouped by category. Exact: the micros of a SKU
    are count x price micros. Equals ``category_revenue(purchase_lines(...))``
    whenever session ids are unique (the purchase-line join cannot fan out),
    which the quality report checks.
    """
    code = F.col("eCommerceAction_action_type")
    per_sku = (hits.where(code == spec.purchase.code).groupBy("productSKU")
               .agg(F.count("session_id").alias("_orders"), F.count(F.lit(1)).alias("_lines")))
    dim = unique_products(products).withColumnRenamed("v2ProductCategory", by)
    j = per_sku.join(dim, "productSKU", "left")
    micros = F.col("_lines") * usd_to_micros(F.coalesce(F.col("_price"), F.lit(0.0)))
    agg = j.groupBy(by).agg(F.sum("_orders").alias("orders"), sum_micros(micros).alias("_micros"),
                            F.sum("_lines").alias("_n"))
    return (agg.select(by, F.col("orders").cast("long").alias("orders"),
                       (F.col("_micros").cast("double") / MICROS).alias("revenue"),
                       (ratio("_micros", "_n") / MICROS).alias("avg_item_value"))
               .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last(by)))


# --- M20 / W4: biggest leak ---------------------------------------------------
def biggest_leak(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                 by: Sequence[str] = ()) -> DataFrame:
    """Stage with the lowest non-NULL step conversion (first stage wins ties)."""
    f = funnel_frame(sessions, spec, by).where(F.col("step_conv").isNotNull())
    g = f.groupBy(*by) if by else f.groupBy()
    best = g.agg(F.min(F.struct("step_conv", "stage_order", "stage")).alias("m"))
    return best.select(*by, F.col("m.stage").alias("stage"), F.col("m.step_conv").alias("step_conv"))
