"""Adapter: the driver's test tables as GA-shaped hits, sessions and products.

The test tables carry no web sessions. A session is one visitor-day; every
``events`` row is a hit. This is a test adapter, not engine logic: the engine
operators only see the GA-shaped frames it returns.

Work grows with the tables: hits are a projection of ``events``; sessions are
one aggregation of hits (shuffle on visitor-day with map-side combine) joined
to the customer/nation dimensions at session grain.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import attach_products, clean_sessions, session_rollup
from ..operators.sequence import sequence_within
from ..spec import DEFAULT_SPEC, FunnelSpec

# --- Fixed values of the adapter ---------------------------------------------
# event_type -> action code: view 2, click 3, signup 5, purchase 6, others 0.
# device from user_id % 10: below 7 desktop, below 9 mobile, else tablet.
# SKU: first run of digits in props ({"k": n}) = part key.
EVENT_CODES = {"view": 2, "click": 3, "signup": 5, "purchase": 6}
UNMAPPED_CODE = 0
DEVICE_CUTS = ((7, "desktop"), (9, "mobile"))
DEVICE_REST = "tablet"
SKU_PATTERN = "([0-9]+)"


# Declared schemas of the test tables the adapter reads (no footer inference
# on every read; identical at every scale of the test data).
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                 "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                 "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code_expr():
    expr = None
    for name, code in EVENT_CODES.items():
        cond = F.col("event_type") == name
        expr = F.when(cond, code) if expr is None else expr.when(cond, code)
    return expr.otherwise(UNMAPPED_CODE).cast("int")


def device_expr():
    m = F.col("user_id") % 10
    expr = None
    for cut, name in DEVICE_CUTS:
        expr = F.when(m < cut, name) if expr is None else expr.when(m < cut, name)
    return expr.otherwise(DEVICE_REST)


def events(spark: SparkSession, sf_dir: str, date_from: str | None = None,
           date_to: str | None = None) -> DataFrame:
    """events, optionally restricted to [date_from, date_to] (inclusive days).

    The range is a predicate on the raw ``ts`` column so it reaches the
    Parquet scan as a pushed filter (row-group skipping).
    """
    ev = table(spark, sf_dir, "events")
    # Wall-clock literals (strings cast to TIMESTAMP_NTZ): no time-zone shift
    # whatever the session or Python process zone is.
    if date_from is not None:
        lo = dt.datetime.strptime(date_from, "%Y%m%d")
        ev = ev.where(F.col("ts") >= F.lit(lo.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
    if date_to is not None:
        hi = dt.datetime.strptime(date_to, "%Y%m%d") + dt.timedelta(days=1)
        ev = ev.where(F.col("ts") < F.lit(hi.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
    return ev


def raw_hits(spark: SparkSession, sf_dir: str, codes: list[int] | None = None, **range_kw) -> DataFrame:
    """GA-shaped hits without product attributes (plus helper columns).

    Helper columns user_id, event_day, ts, event_id, value are kept for the
    session rollup and ordering; unused ones are pruned by the optimizer.
    ``codes`` keeps only hits with those action codes, as a predicate on the
    raw ``event_type`` column, so it reaches the Parquet scan as a pushed
    filter (a filter on the derived code would not).
    """
    ev = events(spark, sf_dir, **range_kw)
    if codes is not None:
        names = [n for n, c in EVENT_CODES.items() if c in codes]
        cond = F.col("event_type").isin(*names)
        if UNMAPPED_CODE in codes:
            cond = cond | ~F.col("event_type").isin(*EVENT_CODES) | F.col("event_type").isNull()
        ev = ev.where(cond)
    return project_hits(ev)


def hits_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same hit projection over a ``readStream`` of the events files.

    ``ts`` becomes a TIMESTAMP (event-time watermarks need one).
    """
    reader = spark.readStream.schema(TABLE_SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(sf_dir.rstrip("/"))
    return project_hits(ev).withColumn("ts", F.col("ts").cast("timestamp"))


def project_hits(ev: DataFrame) -> DataFrame:
    """events rows -> GA-shaped hit columns (batch or streaming input)."""
    day = F.col("ts").cast("date")
    sku = F.expr(f"try_cast(nullif(regexp_extract(props, '{SKU_PATTERN}', 1), '') as bigint)")
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(day, "yyyyMMdd"))
         .alias("session_id"),
        F.lit("EVENT").alias("hit_type"),
        _code_expr().alias("eCommerceAction_action_type"),
        sku.cast("string").alias("productSKU"),
        F.col("user_id"), day.alias("event_day"), F.col("ts"), F.col("event_id"), F.col("value"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("productSKU"),
        F.col("p_type").alias("v2ProductCategory"),
        F.col("p_retailprice").alias("productPrice"))


SEQUENCE_KEYS, SEQUENCE_ORDER = ("user_id", "event_day"), ("ts", "event_id")
PRODUCT_COLUMNS = ("v2ProductCategory", "productPrice")


def minute_of_day():
    """Sequence bucket: a session (a visitor's day) has 1440 at most."""
    return F.hour("ts") * 60 + F.minute("ts")


def hits(spark: SparkSession, sf_dir: str, with_sequence: bool = False,
         columns: list[str] | None = None, codes: list[int] | None = None, **range_kw) -> DataFrame:
    """Hits with product attributes (J6), with ``hitNumber`` when asked.

    ``columns`` narrows the hits; without a product column among them the
    product join is left out. Numbers count all of a session's hits, so
    ``codes`` and ``with_sequence`` don't go together.
    """
    if with_sequence and codes is not None:
        raise ValueError("hit numbers count every hit of a session; filter by code afterwards")
    h = raw_hits(spark, sf_dir, codes=codes, **range_kw)
    if with_sequence:
        h = sequence_within(h, SEQUENCE_KEYS, SEQUENCE_ORDER, minute_of_day(), name="hitNumber")
    if columns is None or set(columns) & set(PRODUCT_COLUMNS):
        h = attach_products(h, products(spark, sf_dir))
    return h if columns is None else h.select(*columns, *["hitNumber"] * with_sequence)


def raw_sessions(spark: SparkSession, sf_dir: str, spec: FunnelSpec = DEFAULT_SPEC,
                 with_flags: bool = True, **range_kw) -> DataFrame:
    """GA-shaped raw sessions: totals (and flags) from one rollup of hits.

    The dimension joins run after the aggregation, at session grain.
    """
    rolled = session_rollup(raw_hits(spark, sf_dir, **range_kw), spec,
                            keys=("user_id", "event_day"), value_col="value", with_flags=with_flags)
    # Dimensions keyed uniquely (one row per key): no fan-out, and the
    # optimizer drops a left join whose columns a query never reads.
    cust = (table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("user_id"))
            .agg(F.max(F.struct("c_mktsegment", "c_nationkey")).alias("_c"))
            .select("user_id", "_c.c_mktsegment", "_c.c_nationkey"))
    nat = (table(spark, sf_dir, "nation").groupBy(F.col("n_nationkey").alias("c_nationkey"))
           .agg(F.max("n_name").alias("n_name")))
    ymd = F.date_format("event_day", "yyyyMMdd")
    s = rolled.join(cust, "user_id", "left").join(nat, "c_nationkey", "left")
    flag_cols = [st.flag for st in spec.hit_stages] if with_flags else []
    return s.select(
        F.col("user_id").cast("string").alias("fullVisitorId"),
        ymd.cast("long").alias("visitId"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), ymd).alias("session_id"),
        ymd.alias("date"),
        F.col("c_mktsegment").alias("channelGrouping"),
        device_expr().alias("deviceCategory"),
        F.col("n_name").alias("country"),
        "totals_pageviews", "totals_bounces", "totals_hits", "totals_transactions",
        "totals_transactionRevenue", *flag_cols)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as purchase hits: one purchase line per order line.

    session_id = order key, productSKU = part key, action code = purchase.
    Lets the category-revenue operator run over the largest test table.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("session_id"),
                     F.lit(EVENT_CODES["purchase"]).alias("eCommerceAction_action_type"),
                     F.col("l_partkey").cast("string").alias("productSKU"))


@dataclass
class Model:
    """The GA-shaped frames for one test-data directory (all lazy)."""
    spark: SparkSession
    sf_dir: str
    spec: FunnelSpec = DEFAULT_SPEC
    date_from: str | None = None
    date_to: str | None = None

    @property
    def _kw(self) -> dict:
        return {"date_from": self.date_from, "date_to": self.date_to}

    def hits(self, with_sequence: bool = False, columns: list[str] | None = None,
             codes: list[int] | None = None) -> DataFrame:
        return hits(self.spark, self.sf_dir, with_sequence=with_sequence, columns=columns, codes=codes,
                    **self._kw)

    def raw_sessions(self, with_flags: bool = False) -> DataFrame:
        return raw_sessions(self.spark, self.sf_dir, self.spec, with_flags=with_flags, **self._kw)

    def products(self) -> DataFrame:
        return products(self.spark, self.sf_dir)

    def sessions(self) -> DataFrame:
        """Clean sessions via the fused rollup (totals + flags in one pass)."""
        return clean_sessions(self.raw_sessions(with_flags=True), None, self.spec)


def load(spark: SparkSession, sf_dir: str, spec: FunnelSpec = DEFAULT_SPEC,
         date_from: str | None = None, date_to: str | None = None) -> Model:
    return Model(spark, sf_dir, spec, date_from, date_to)
