"""Report-level operators: KPI measures (M23), totals (M25), chart labels (M27),
the all-grain metric cube (M28) and the findings document (M26).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag_count, percent_label, ratio, sum_micros, thousands
from ..spec import DEFAULT_SPEC, MICROS, FunnelSpec
from .funnel import stage_counts
from .stats import opportunity_columns, ztest_columns


# --- M25: totals block --------------------------------------------------------
def totals(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """total_sessions, total_orders, total_revenue, overall_conversion."""
    c = sessions.agg(F.count("session_id").alias("total_sessions"),
                     flag_count(spec.purchase.flag).alias("total_orders"),
                     sum_micros("revenue_micros").alias("_m"))
    return c.select("total_sessions", "total_orders",
                    (F.col("_m").cast("double") / MICROS).alias("total_revenue"),
                    ratio("total_orders", "total_sessions").alias("overall_conversion"))


# --- M23: KPI measures over the channel table ---------------------------------
def kpi_measures(channel_table: DataFrame) -> DataFrame:
    """Overall Conversion, Total Revenue, Total Orders, AOV, Total Sessions.

    A second-level aggregate of the channel table (a handful of rows). Uses
    exact micros when the table carries them, else sums the revenue column.
    """
    rev = (sum_micros("revenue_micros").cast("double") / MICROS if "revenue_micros" in channel_table.columns
           else F.sum("revenue"))
    c = channel_table.agg(F.coalesce(F.sum("sessions"), F.lit(0)).cast("long").alias("total_sessions"),
                          F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("total_orders"),
                          rev.alias("total_revenue"))
    return c.select(ratio("total_orders", "total_sessions").alias("overall_conversion"),
                    "total_revenue", "total_orders",
                    ratio("total_revenue", "total_orders").alias("aov"), "total_sessions")


# --- M27: chart labels --------------------------------------------------------
def funnel_labels(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                  by: Sequence[str] = ()) -> DataFrame:
    """stage, stage_order, count, label like '71,456 (47.6%)'."""
    wide = stage_counts(sessions, spec, by)
    rows = F.array(*[F.struct(F.lit(lbl).alias("stage"), F.lit(i).alias("stage_order"),
                              F.col(f"c{i}").alias("count"),
                              F.concat(thousands(f"c{i}"), F.lit(" ("), percent_label(f"c{i}", "c0", 1),
                                       F.lit(")")).alias("label"))
                     for i, lbl in enumerate(spec.labels)])
    return wide.select(*by, F.inline(rows))


def segment_rate_labels(sessions: DataFrame, by: str = "device",
                        spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """segment, sessions, orders, overall_conversion, label like '1.72%'."""
    c = sessions.groupBy(by).agg(F.count("session_id").alias("sessions"),
                                 flag_count(spec.purchase.flag).alias("orders"))
    return c.select(by, "sessions", "orders", ratio("orders", "sessions").alias("overall_conversion"),
                    percent_label("orders", "sessions", 2).alias("label"))


# --- M28: all-grain metric cube -----------------------------------------------
CUBE_SETS = ((), ("device",), ("channel",), ("device", "channel"), ("date",))
# level = grouping(device)*4 + grouping(channel)*2 + grouping(date)
LEVEL_TOTAL, LEVEL_DEVICE, LEVEL_CHANNEL, LEVEL_MATRIX, LEVEL_DATE = 7, 3, 5, 1, 6


def metric_cube(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                sets: Sequence[Sequence[str]] = CUBE_SETS,
                dims: Sequence[str] = ("device", "channel", "date")) -> DataFrame:
    """Every dashboard grain in one pass over sessions.

    All measures add up, so sessions are first counted by all ``dims``, and
    GROUPING SETS expand that small table rather than the sessions. Rows of
    each grain are identified by ``level`` (grouping bitmask over ``dims``),
    so NULL segment values stay distinct from rolled-up columns.
    """
    return expand_cube(cube_base(sessions, spec, dims), spec, sets, dims)


def cube_base(sessions: DataFrame, spec: FunnelSpec, dims: Sequence[str]) -> DataFrame:
    """Sessions counted by all ``dims``: measures that add up."""
    return sessions.groupBy(*dims).agg(
        F.count("session_id").alias("sessions"),
        *[flag_count(f).alias(n) for f, n in zip(spec.flags[:-1], spec.count_names[:-1])],
        flag_count(spec.purchase.flag).alias("orders"), sum_micros("revenue_micros").alias("revenue_micros"))


def expand_cube(base: DataFrame, spec: FunnelSpec, sets: Sequence[Sequence[str]], dims: Sequence[str]) -> DataFrame:
    """The grains of ``sets`` from rows counted by all ``dims``."""
    names = ["sessions", *spec.count_names[:-1], "orders", "revenue_micros"]
    g = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims])
    level = sum((F.grouping(d) * (2 ** (len(dims) - 1 - i)) for i, d in enumerate(dims)), F.lit(0))
    agg = g.agg(level.cast("int").alias("level"),
                *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
    return agg.select("level", *dims, "sessions", *spec.count_names[:-1], "orders",
                      (F.col("revenue_micros").cast("double") / MICROS).alias("revenue"),
                      ratio("orders", "sessions").alias("conversion_rate"), "revenue_micros")


def cube_grain(cube: DataFrame, level: int, keys: Sequence[str]) -> DataFrame:
    """One grain of the cube, without the rolled-up key columns."""
    drop = [d for d in ("device", "channel", "date") if d not in keys]
    return cube.where(F.col("level") == level).drop("level", *drop)


# --- M26: findings document ---------------------------------------------------
#: Values of a segment column that one findings document lists at most.
MAX_SEGMENTS = 10_000


def findings(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, seg: str = "device",
             hi: str = "desktop", lo: str = "mobile", channel: str = "channel",
             share: float = 0.5, periods_per_year: float = 12 / 3) -> DataFrame:
    """One row holding every headline result as scalars, structs and arrays.

    One scan of sessions, counted by (seg, channel); GROUPING SETS ((), (seg),
    (channel)) over that small table, and one global aggregate builds the
    document. No cross join, no collect. The document lists every value of
    ``seg`` and ``channel``, so choose columns with few of them: more than
    ``MAX_SEGMENTS`` values of either raise an error instead of filling a task.
    """
    flags = spec.flags
    n = len(flags)
    base = sessions.groupBy(seg, channel).agg(
        F.count("session_id").alias("c0"), *[flag_count(f).alias(f"c{i + 1}") for i, f in enumerate(flags)],
        sum_micros("revenue_micros").alias("m"),
        F.coalesce(F.sum(F.when(F.col(spec.purchase.flag), F.coalesce(F.col("revenue_micros"), F.lit(0)))), F.lit(0))
        .alias("bm"))
    g = base.groupingSets([[], [F.col(seg)], [F.col(channel)]], F.col(seg), F.col(channel))
    small = g.agg((F.grouping(seg) * 2 + F.grouping(channel)).cast("int").alias("lvl"),
                  *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
                    for c in ["c0", *[f"c{i + 1}" for i in range(n)], "m", "bm"]])
    place = F.row_number().over(Window.partitionBy("lvl").orderBy(F.desc("c0"), F.asc_nulls_last(seg),
                                                                  F.asc_nulls_last(channel)))
    small = small.withColumn("_place", place).withColumn("lvl", F.when(
        F.col("_place") > MAX_SEGMENTS, F.raise_error(F.lit(
            f"{seg} or {channel} has more than {MAX_SEGMENTS} values"))).otherwise(F.col("lvl"))).drop("_place")
    total, by_seg, by_ch = F.col("lvl") == 3, F.col("lvl") == 1, F.col("lvl") == 2

    def tot(c: str):
        return F.max(F.when(total, F.col(c)))

    def seg_val(value: str, c: str):
        return F.max(F.when(by_seg & (F.col(seg) == value), F.col(c)))

    names = [f"{a}_to_{b}" for a, b in zip(spec.step_names[:-1], spec.step_names[1:])]
    dev_struct = F.struct(ratio(f"c{n}", "c0").alias("overall_conv"), F.col(seg).alias(seg),
                          F.col("c0").alias("sessions"),
                          *[ratio(f"c{i + 1}", f"c{i}").alias(names[i - 1]) for i in range(1, n)])
    ch_struct = F.struct(ratio(f"c{n}", "c0").alias("conv"), F.col(channel).alias(channel),
                         F.col("c0").alias("sessions"), (F.col("m").cast("double") / MICROS).alias("revenue"),
                         ratio(F.col("m").cast("double") / MICROS, "c0").alias("rev_per_session"))
    doc = small.agg(
        *[tot(f"c{i}").alias(f"t{i}") for i in range(n + 1)], tot("m").alias("tm"), tot("bm").alias("tbm"),
        F.sort_array(F.collect_list(F.when(by_seg, dev_struct)), asc=False).alias("_dev"),
        F.sort_array(F.collect_list(F.when(by_ch, ch_struct)), asc=False).alias("_ch"),
        seg_val(hi, "c0").alias("n_hi"), seg_val(hi, f"c{n}").alias("x_hi"),
        seg_val(lo, "c0").alias("n_lo"), seg_val(lo, f"c{n}").alias("x_lo"))

    t = [F.coalesce(F.col(f"t{i}"), F.lit(0)) for i in range(n + 1)]
    overall = F.array(*[F.struct(F.lit(lbl).alias("stage"), t[i].alias("count"),
                                 ratio(t[i], t[0]).alias("pct_of_sessions"),
                                 (ratio(t[i], t[i - 1]) if i else F.lit(None).cast("double")).alias("step_conv"))
                        for i, lbl in enumerate(spec.labels)])
    steps = F.filter(overall, lambda r: r["step_conv"].isNotNull())
    leak = F.aggregate(F.slice(steps, 2, n + 1), F.try_element_at(steps, F.lit(1)),
                       lambda acc, r: F.when(r["step_conv"] < acc["step_conv"], r).otherwise(acc))
    zt = ztest_columns(F.col("n_hi"), F.col("x_hi"), F.col("n_lo"), F.col("x_lo"))
    op = opportunity_columns(F.col("n_hi"), F.col("x_hi"), F.col("n_lo"), F.col("x_lo"),
                             t[n], F.coalesce(F.col("tbm"), F.lit(0)), share, periods_per_year)
    dev_fields = [seg, "sessions", *names, "overall_conv"]
    ch_fields = [channel, "sessions", "conv", "revenue", "rev_per_session"]
    return doc.select(
        overall.alias("overall_funnel"),
        ratio(t[n], t[0]).alias("overall_conversion"),
        t[0].alias("total_sessions"), t[n].alias("total_orders"),
        (F.coalesce(F.col("tm"), F.lit(0)).cast("double") / MICROS).alias("total_revenue"),
        leak["stage"].alias("biggest_leak_stage"), leak["step_conv"].alias("biggest_leak_step_conv"),
        F.transform("_dev", lambda r: F.struct(*[r[f].alias(f) for f in dev_fields])).alias(f"by_{seg}"),
        F.transform("_ch", lambda r: F.struct(*[r[f].alias(f) for f in ch_fields])).alias(f"by_{channel}"),
        F.struct(zt["rate_a"].alias(f"{hi}_rate"), zt["rate_b"].alias(f"{lo}_rate"),
                 zt["z"].alias("z"), zt["p_value"].alias("p_value")).alias(f"{hi}_vs_{lo}"),
        op["aov"].alias("aov"),
        op["extra_orders_period"].alias("recovery_extra_orders_period"),
        op["extra_revenue_period"].alias("recovery_extra_revenue_period"),
        op["extra_revenue_annualized"].alias("recovery_extra_revenue_annualized"))


def findings_rows(document: DataFrame, sections: Sequence[str] = ("overall_funnel", "by_device", "by_channel")) -> DataFrame:
    """E19 turned back: section, position (from 1), name and the numbers of each
    element of the document's arrays, as (measure, value) rows."""
    fields = {s: [f.name for f in document.schema[s].dataType.elementType.fields] for s in sections}

    def values(section: str):
        name, *measures = fields[section]
        return F.transform(section, lambda e, i: F.struct(
            F.lit(section).alias("section"), (i + 1).alias("position"), e[name].alias("name"),
            F.array(*[F.struct(F.lit(m).alias("measure"), e[m].cast("double").alias("value")) for m in measures])
            .alias("values")))

    rows = document.select(F.inline(F.concat(*[values(s) for s in sections])))
    return rows.select("section", "position", "name", F.inline("values"))
