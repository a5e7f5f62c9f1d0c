"""Registered queries: one callable per operator of the inventory.

Each callable takes ``(spark, sf_dir)``, reads the test tables through the
adapter and returns a lazy DataFrame over the whole tables. Column names match
the oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.columns import clamp
from ..operators import cleaning, daily_state, funnel, nested, reports, stage_table, stats
from ..session import scratch_path
from ..sinks import publish, writers
from ..sources import day_tables, files, rejects, testdata
from ..spec import DEFAULT_SPEC
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed window for the date-range scan query (inclusive, yyyyMMdd).
RANGE_FROM, RANGE_TO = "20240105", "20240111"


def query(name: str):
    def register(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return register


def _model(spark: SparkSession, sf: str, **kw) -> testdata.Model:
    return testdata.load(spark, sf, **kw)


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf).sessions()


def _purchases(spark: SparkSession, sf: str) -> DataFrame:
    m = _model(spark, sf)
    buy = [m.spec.purchase.code]      # read only purchase events (pushed to the scan)
    return cleaning.purchase_lines(m.hits(codes=buy), m.raw_sessions())


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records cut by the hour of the hit: no hit numbers and no probe of sizes."""
    m = _model(spark, sf)
    h = m.hits(columns=["session_id", cleaning.CODE, "ts", "event_id"])
    return nested.to_nested_sessions(m.raw_sessions(), h, bucket=F.hour("ts"), order=testdata.SEQUENCE_ORDER)


def _sparse_sessions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers as sessions and their events as hits: ids that have no hit, that
    have many, and (by the customer's name, on the other side) that repeat."""
    c = testdata.table(spark, sf, "customer")
    e = testdata.table(spark, sf, "events")
    return (c.select(F.col("c_custkey").cast("string").alias("session_id"), "c_mktsegment", "c_nationkey"),
            e.select(F.col("user_id").cast("string").alias("session_id")))


def _ten_digits(c: str):
    """A number to ten digits: as far as the oracle's numerical integral is compared."""
    return F.format_string("%.9e", F.col(c)).cast("double")


# --- cleaning / transform -----------------------------------------------------
@query("quality_report")
def q_quality_report(spark, sf):
    m = _model(spark, sf)
    return cleaning.quality_report(m.raw_sessions(), m.hits(columns=["session_id"]))


@query("quality_report_customers")
def q_quality_report_customers(spark, sf):
    """The report over whole tables: events as sessions (ids repeat), customers as hits."""
    customers, events = _sparse_sessions(spark, sf)
    return cleaning.quality_report(events, customers)


@query("quality_report_orders")
def q_quality_report_orders(spark, sf):
    """The report where its checks find something, over whole tables: orders as sessions
    by their customer (ids repeat), events as hits (some customers have none)."""
    orders, (_, events) = testdata.table(spark, sf, "orders"), _sparse_sessions(spark, sf)
    return cleaning.quality_report(orders.select(F.col("o_custkey").cast("string").alias("session_id")), events)


def _typed_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as an export of text that is not clean: ids that are missing, days and months
    that do not exist, counts that are letters."""
    day = F.concat(F.year("o_orderdate"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"),
                   F.lpad((F.col("o_custkey") % 33).cast("string"), 2, "0"))
    views = F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderstatus")).otherwise(F.substring("o_orderpriority", 1, 1))
    return testdata.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("session_id"),
        day.alias("date"), views.alias("totals_pageviews"))


TEXT_SCHEMA = StructType([StructField("session_id", StringType()), StructField("date", StringType()),
                          StructField("totals_pageviews", IntegerType())])


@query("rejected_cells")
def q_rejected_cells(spark, sf):
    return rejects.split(_typed_text(spark, sf), TEXT_SCHEMA).rejects


@query("typed_sessions")
def q_typed_sessions(spark, sf):
    return cleaning.tolerant_dates(rejects.split(_typed_text(spark, sf), TEXT_SCHEMA).good)


@query("quality_report_dates")
def q_quality_report_dates(spark, sf):
    """M1 with E9: dates that do not parse are counted, and every row stays."""
    lines = testdata.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"))
    return cleaning.quality_report(_typed_text(spark, sf), lines, date="date")


@query("clean_sessions")
def q_clean_sessions(spark, sf):
    return _sessions(spark, sf)


@query("clean_sessions_joined")
def q_clean_sessions_joined(spark, sf):
    """Flags aggregated from the hits and joined to the sessions."""
    m = _model(spark, sf)
    return cleaning.clean_sessions(m.raw_sessions(), m.hits(columns=["session_id", cleaning.CODE]))


@query("purchase_lines")
def q_purchase_lines(spark, sf):
    return _purchases(spark, sf)


@query("event_log")
def q_event_log(spark, sf):
    m = _model(spark, sf)
    cols = ["session_id", cleaning.CODE, "productSKU", "v2ProductCategory"]
    return cleaning.event_log(m.hits(with_sequence=True, columns=cols), m.raw_sessions())


@query("nested_sessions")
def q_nested_sessions(spark, sf):
    return nested.flatten_nested(_nested(spark, sf))


@query("day_tables")
def q_day_tables(spark, sf):
    """Nested records written as a table a day, those of a range read back and flattened."""
    root = scratch_path(spark, "day-tables")
    writers.write_day_tables(_nested(spark, sf), root)
    days = day_tables.read_day_tables(spark, root, RANGE_FROM, RANGE_TO, schema=files.NESTED_WITH_FRAGMENT)
    return nested.flatten_nested(days)


@query("pipeline_summary")
def q_pipeline_summary(spark, sf):
    m = _model(spark, sf)
    h, raw = m.hits(columns=["session_id", cleaning.CODE, "productSKU", *testdata.PRODUCT_COLUMNS]), m.raw_sessions()
    return cleaning.pipeline_summary(m.sessions(), cleaning.purchase_lines(h, raw),
                                     cleaning.event_log(h, raw))


@query("action_counts")
def q_action_counts(spark, sf):
    return cleaning.action_counts(_model(spark, sf).hits(columns=[cleaning.CODE]))


@query("join_hits_sessions")
def q_join_hits_sessions(spark, sf):
    m = _model(spark, sf)
    cols = ["event_id", "session_id", "eCommerceAction_action_type", "productSKU"]
    j = cleaning.join_hits_sessions(m.hits(columns=cols), m.raw_sessions())
    return j.select("event_id", "session_id", "eCommerceAction_action_type", "productSKU",
                    "channel", "device", "date")


@query("sessions_without_hits")
def q_sessions_without_hits(spark, sf):
    """Sessions without a hit of a mapped stage (each session here has some hit)."""
    m = _model(spark, sf)
    mapped = m.hits(codes=m.spec.codes, columns=["session_id"])          # pushed to the scan
    return cleaning.sessions_without_hits(m.raw_sessions(), mapped).select(
        "session_id", "fullVisitorId", "date", "deviceCategory")


@query("customers_without_events")
def q_customers_without_events(spark, sf):
    """J5 over ids that may have no row at all on the other side."""
    customers, events = _sparse_sessions(spark, sf)
    return cleaning.sessions_without_hits(customers, events)


@query("hits_products")
def q_hits_products(spark, sf):
    m = _model(spark, sf)
    h = cleaning.attach_products(testdata.raw_hits(spark, sf), m.products())
    return h.select("event_id", "session_id", "productSKU", "v2ProductCategory", "productPrice")


@query("stage_sets")
def q_stage_sets(spark, sf):
    m = _model(spark, sf)
    s = cleaning.stage_sets(m.hits(codes=m.spec.codes, columns=["session_id", cleaning.CODE]))
    return s.select("session_id", F.array_join("stages", ",").alias("stages"))


@query("session_totals")
def q_session_totals(spark, sf):
    return cleaning.session_rollup(testdata.raw_hits(spark, sf), value_col="value")


@query("hit_sequence")
def q_hit_sequence(spark, sf):
    return _model(spark, sf).hits(with_sequence=True, columns=["session_id", "event_id"])


@query("duplicate_sessions")
def q_duplicate_sessions(spark, sf):
    return cleaning.duplicate_keys(_model(spark, sf).raw_sessions(), "session_id")


@query("duplicate_order_keys")
def q_duplicate_order_keys(spark, sf):
    """A10 on a key that repeats: the order of each order line."""
    return cleaning.duplicate_keys(testdata.table(spark, sf, "lineitem"), "l_orderkey")


@query("date_range_scan")
def q_date_range_scan(spark, sf):
    s = _model(spark, sf, date_from=RANGE_FROM, date_to=RANGE_TO).sessions()
    return funnel.daily_trend(s)


# --- nested source --------------------------------------------------------------
@query("exists_flags")
def q_exists_flags(spark, sf):
    flat = nested.flatten_nested(_nested(spark, sf))
    return flat.select("session_id", *[st.flag for st in DEFAULT_SPEC.hit_stages])


@query("nested_daily")
def q_nested_daily(spark, sf):
    return funnel.daily_trend(nested.flatten_nested(_nested(spark, sf)))


@query("nested_cube")
def q_nested_cube(spark, sf):
    return reports.metric_cube(nested.flatten_nested(_nested(spark, sf))).drop("revenue_micros")


@query("nested_funnel")
def q_nested_funnel(spark, sf):
    return sql.run(spark, sql.NESTED_FUNNEL, sessions=sql.sessions_view(nested.flatten_nested(_nested(spark, sf))))


@query("nested_device")
def q_nested_device(spark, sf):
    return sql.run(spark, sql.NESTED_DEVICE, sessions=sql.sessions_view(nested.flatten_nested(_nested(spark, sf))))


@query("nested_channel")
def q_nested_channel(spark, sf):
    return sql.run(spark, sql.NESTED_CHANNEL, sessions=sql.sessions_view(nested.flatten_nested(_nested(spark, sf))))


@query("nested_matrix")
def q_nested_matrix(spark, sf):
    return sql.run(spark, sql.NESTED_MATRIX, sessions=sql.sessions_view(nested.flatten_nested(_nested(spark, sf))))


# --- funnel metrics -------------------------------------------------------------
@query("funnel_overall")
def q_funnel_overall(spark, sf):
    return funnel.funnel_frame(_sessions(spark, sf))


@query("stage_table_funnel")
def q_stage_table_funnel(spark, sf):
    """The default four stages, as a table that the hits meet; the purchase comes from the totals."""
    m = _model(spark, sf)
    stages = spark.createDataFrame([(None if not s.from_hits else s.code, s.label, i) for i, s in enumerate(m.spec.stages, 1)],
                                   "code int, stage string, stage_order long")
    masks = stage_table.stage_masks(m.hits(columns=["session_id", cleaning.CODE]), stages)
    masked = stage_table.with_masks(m.raw_sessions(), masks, totals={len(m.spec.stages): F.col("totals_transactions") > 0})
    return stage_table.stage_funnel(masked, stages, entry=m.spec.entry_label)


@query("stage_table_months")
def q_stage_table_months(spark, sf):
    """Twelve stages that the data bring along. Orders reach the months in which their lines were shipped."""
    lines = testdata.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.month("l_shipdate").alias(cleaning.CODE))
    stages = lines.select(F.col(cleaning.CODE).alias("code"), F.concat(F.lit("month "), F.col(cleaning.CODE)).alias("stage"),
                          F.col(cleaning.CODE).alias("stage_order")).where("code IS NOT NULL").distinct()
    orders = testdata.table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), "o_orderstatus")
    masked = stage_table.with_masks(orders, stage_table.stage_masks(lines, stages))
    return stage_table.stage_funnel(masked, stages, by=("o_orderstatus",), entry="Orders")


@query("device_funnel")
def q_device_funnel(spark, sf):
    return funnel.funnel_frame_windowed(_sessions(spark, sf), by=["device"])


@query("funnel_stage")
def q_funnel_stage(spark, sf):
    return funnel.funnel_stage(_sessions(spark, sf))


@query("union_stages")
def q_union_stages(spark, sf):
    return sql.run(spark, sql.STAGE_UNION, sessions=sql.sessions_view(_sessions(spark, sf)))


@query("step_conversion")
def q_step_conversion(spark, sf):
    return sql.run(spark, sql.STEP_CONVERSION, sessions=sql.sessions_view(_sessions(spark, sf)))


@query("device_rates")
def q_device_rates(spark, sf):
    return funnel.segment_rates(_sessions(spark, sf), "device")


@query("device_rates_sql")
def q_device_rates_sql(spark, sf):
    return sql.run(spark, sql.DEVICE_RATES, sessions=sql.sessions_view(_sessions(spark, sf)))


@query("funnel_by_device")
def q_funnel_by_device(spark, sf):
    return funnel.funnel_by_segment(_sessions(spark, sf), "device")


@query("channel_performance")
def q_channel_performance(spark, sf):
    return funnel.channel_performance(_sessions(spark, sf))


@query("channel_performance_sql")
def q_channel_performance_sql(spark, sf):
    return sql.run(spark, sql.CHANNEL_PERFORMANCE, sessions=sql.sessions_view(_sessions(spark, sf)))


@query("device_channel_matrix")
def q_device_channel_matrix(spark, sf):
    return funnel.segment_matrix(_sessions(spark, sf))


@query("worst_pockets")
def q_worst_pockets(spark, sf):
    return funnel.worst_pockets(_sessions(spark, sf), k=10)


@query("worst_pockets_sql")
def q_worst_pockets_sql(spark, sf):
    return sql.run(spark, sql.WORST_POCKETS, sessions=sql.sessions_view(_sessions(spark, sf)), k=10)


def _ranked(frame: DataFrame, by: list) -> DataFrame:
    """The place of each row in the report's own order. One window over all rows: they are a row per segment, a few at any scale."""
    return frame.withColumn("place", F.row_number().over(Window.orderBy(*by)))


@query("device_rates_ranked")
def q_device_rates_ranked(spark, sf):
    """O1: best conversion first, as a column that can be compared."""
    rates = funnel.segment_rates(_sessions(spark, sf), "device")
    return _ranked(rates, [F.desc_nulls_last("overall_conversion"), F.asc_nulls_last("device")])


@query("funnel_by_device_ranked")
def q_funnel_by_device_ranked(spark, sf):
    """Segments in the order of their name, as a column that can be compared."""
    return _ranked(funnel.funnel_by_segment(_sessions(spark, sf), "device"), [F.asc_nulls_last("device")])


@query("daily_trend")
def q_daily_trend(spark, sf):
    return funnel.daily_trend(_sessions(spark, sf))


@query("daily_trend_by_device")
def q_daily_trend_by_device(spark, sf):
    return funnel.daily_trend(_sessions(spark, sf), by=["device"])


@query("daily_trend_head")
def q_daily_trend_head(spark, sf):
    return sql.run(spark, sql.DAILY_TREND_HEAD, sessions=sql.sessions_view(_sessions(spark, sf)), n=15)


@query("category_revenue")
def q_category_revenue(spark, sf):
    m = _model(spark, sf)
    buy = [m.spec.purchase.code]
    return funnel.category_revenue_from_hits(testdata.raw_hits(spark, sf, codes=buy), m.products())


@query("category_revenue_orders")
def q_category_revenue_orders(spark, sf):
    return funnel.category_revenue_from_hits(testdata.order_lines(spark, sf), testdata.products(spark, sf))


@query("category_revenue_lines")
def q_category_revenue_lines(spark, sf):
    return funnel.category_revenue(_purchases(spark, sf))


@query("category_revenue_sql")
def q_category_revenue_sql(spark, sf):
    return sql.run(spark, sql.CATEGORY_REVENUE, purchases=sql.purchases_view(_purchases(spark, sf)))


@query("biggest_leak")
def q_biggest_leak(spark, sf):
    return funnel.biggest_leak(_sessions(spark, sf))


# --- statistics and reports -----------------------------------------------------
@query("device_ztest")
def q_device_ztest(spark, sf):
    return stats.two_proportion_test(_sessions(spark, sf), "device", "desktop", "mobile") \
        .withColumn("p_value", _ten_digits("p_value"))


@query("gap_opportunity")
def q_gap_opportunity(spark, sf):
    return stats.gap_opportunity(_sessions(spark, sf), "device", "desktop", "mobile")


@query("gap_ratio")
def q_gap_ratio(spark, sf):
    return stats.gap_ratio(_sessions(spark, sf), "device", "desktop", "mobile")


@query("aov")
def q_aov(spark, sf):
    return stats.aov(_sessions(spark, sf))


@query("kpi_measures")
def q_kpi_measures(spark, sf):
    return reports.kpi_measures(funnel.channel_performance(_sessions(spark, sf), keep_micros=True))


@query("totals")
def q_totals(spark, sf):
    return reports.totals(_sessions(spark, sf))


@query("funnel_labels")
def q_funnel_labels(spark, sf):
    return reports.funnel_labels(_sessions(spark, sf))


@query("device_labels")
def q_device_labels(spark, sf):
    return reports.segment_rate_labels(_sessions(spark, sf), "device")


@query("metric_cube")
def q_metric_cube(spark, sf):
    return reports.metric_cube(_sessions(spark, sf)).drop("revenue_micros")


@query("findings")
def q_findings(spark, sf):
    return reports.findings(_sessions(spark, sf))


@query("findings_scalars")
def q_findings_scalars(spark, sf):
    """The scalar content of the findings document, flattened (SQL-checkable)."""
    d = reports.findings(_sessions(spark, sf))
    return d.select("overall_conversion", "total_sessions", "total_orders", "total_revenue",
                    "biggest_leak_stage", "biggest_leak_step_conv",
                    F.col("desktop_vs_mobile.desktop_rate").alias("desktop_rate"),
                    F.col("desktop_vs_mobile.mobile_rate").alias("mobile_rate"),
                    F.col("desktop_vs_mobile.z").alias("z"), _ten_digits("desktop_vs_mobile.p_value").alias("p_value"),
                    "aov", "recovery_extra_orders_period", "recovery_extra_revenue_period",
                    "recovery_extra_revenue_annualized")


@query("findings_rows")
def q_findings_rows(spark, sf):
    """The arrays of the findings document, a row per element and value."""
    return reports.findings_rows(reports.findings(_sessions(spark, sf)))


# --- sinks, read back ---------------------------------------------------------
@query("raw_csv")
def q_raw_csv(spark, sf):
    """Raw sessions as CSV in the shared folder, read with the declared schema."""
    path = scratch_path(spark, "raw-sessions")
    raw = _model(spark, sf).raw_sessions()
    writers.write_csv(raw, path)
    return files.read_raw_sessions(spark, path).select(*raw.columns)


@query("processed_csv")
def q_processed_csv(spark, sf):
    """Clean sessions as CSV without micros, which follow from the revenue."""
    path = scratch_path(spark, "clean-sessions")
    writers.write_csv(_sessions(spark, sf).drop("revenue_micros"), path)
    clean = files.read_clean_sessions(spark, path, "csv")
    return clean.withColumn("revenue_micros", F.nullif("revenue_micros", F.lit(0)))


@query("json_document")
def q_json_document(spark, sf):
    """K2: a one-row document, written and read back."""
    path, m = scratch_path(spark, "document"), _model(spark, sf)
    report = cleaning.quality_report(m.raw_sessions(), m.hits(columns=["session_id"]))
    writers.write_json_document(report, path)
    return spark.read.schema(report.schema).json(path)


@query("interleaved_layout")
def q_interleaved_layout(spark, sf):
    """K4: sessions in an order that serves device and channel alike, read through either filter."""
    path = scratch_path(spark, "interleaved")
    writers.write_interleaved(_sessions(spark, sf), path)
    rows = spark.read.parquet(path)
    by = lambda c, v: rows.where(F.col(c) == v).groupBy(F.lit(c).alias("filter"), F.col(c).alias("value")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("purchased").alias("orders"))
    return by("device", "mobile").unionByName(by("channel", "BUILDING"))


def _long(name: str, df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """An extract's rows as (extract, key, sessions, orders, revenue)."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    types = {"sessions": "long", "orders": "long", "revenue": "double"}
    return df.select(F.lit(name).alias("extract"), key.alias("key"), *[
        (F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _united_extracts(tables) -> DataFrame:
    shapes = {"funnel_stage": (["stage"], {"sessions": "sessions"}),
              "funnel_by_device": (["device"], {"sessions": "sessions", "orders": "purchase", "revenue": "revenue"}),
              "channel_performance": (["channel"], {"sessions": "sessions", "orders": "orders", "revenue": "revenue"}),
              "device_channel_matrix": (["device", "channel"], {"sessions": "sessions", "orders": "orders"}),
              "daily_trend": (["date"], {"sessions": "sessions", "orders": "orders", "revenue": "revenue"}),
              "category_revenue": (["category"], {"orders": "orders", "revenue": "revenue"})}
    parts = [_long(name, tables[name], keys, **columns) for name, (keys, columns) in shapes.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("published_extracts")
def q_published_extracts(spark, sf):
    """K5: the six extracts published as one version, read back through its manifest."""
    root = scratch_path(spark, "published")
    done = publish.publish_extracts(spark, _sessions(spark, sf), _purchases(spark, sf), root, "parquet")
    return _united_extracts({n: publish.read_published(spark, root, n, done) for n in done.tables})


@query("daily_state_extracts")
def q_daily_state_extracts(spark, sf):
    """M28, M17, K5 by day: the extracts from the days' stored states."""
    root = scratch_path(spark, "daily-state")
    daily_state.write_state(_sessions(spark, sf), _purchases(spark, sf), root)
    return _united_extracts(daily_state.extracts_from_state(spark, root))


@query("clamped_steps")
def q_clamped_steps(spark, sf):
    """Step rates, which an open funnel may put above 1, held between 0 and 1."""
    frame = funnel.funnel_frame(_sessions(spark, sf), by=("device",))
    return frame.select("device", "stage", F.when(F.col("step_conv").isNotNull(), clamp("step_conv", 0.0, 1.0)).alias("step_conv"))
