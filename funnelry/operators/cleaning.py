"""Clean / transform operators: raw sessions + hits -> analysis tables.

Every function is lazy (DataFrame in, DataFrame out). Aggregations per
session use algebraic aggregates (count, max, sum) so Spark combines them
map-side before the shuffle: a hot session collapses to one partial row per
task instead of being gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (flag_count, micros_to_usd, parse_yyyymmdd, ratio,
                                 stage_code_to_event, sum_micros, usd_to_micros)
from ..spec import DEFAULT_SPEC, FunnelSpec

CODE = "eCommerceAction_action_type"


def _code() -> Column:
    return F.col(CODE)


# --- J6: hits with product attributes ----------------------------------------
def unique_products(products: DataFrame) -> DataFrame:
    """One row per SKU: of repeated SKUs the largest (category, price), whole."""
    return (products.groupBy("productSKU")
            .agg(F.max(F.struct("v2ProductCategory", F.col("productPrice").alias("_price"))).alias("_p"))
            .select("productSKU", "_p.v2ProductCategory", "_p._price"))


def attach_products(hits: DataFrame, products: DataFrame) -> DataFrame:
    """Left join hits to the product dimension by SKU; hits never fan out.

    Unknown SKUs keep a NULL category and a 0.0 price. The join runs on a hash
    of the SKU and compares the SKU besides. Both sides therefore get an
    exchange of their own, which is what lets adaptive execution split a hot
    SKU (it cannot where an aggregate sits between exchange and join). A hit
    without a SKU, which most real hits are, gets the hash of its session id:
    such rows spread evenly and match nothing. No broadcast hint: Spark
    broadcasts the dimension while it is under its size threshold.
    """
    p = unique_products(products).select(F.xxhash64("productSKU").alias("_at"), F.col("productSKU").alias("_sku"),
                                         "v2ProductCategory", "_price")
    h = hits.drop("v2ProductCategory", "productPrice").withColumn(
        "_at", F.when(F.col("productSKU").isNull(), F.xxhash64("session_id")).otherwise(F.xxhash64("productSKU")))
    return (h.join(p, (h["_at"] == p["_at"]) & (h["productSKU"] == p["_sku"]), "left")
             .withColumn("productPrice", F.coalesce(F.col("_price"), F.lit(0.0)))
             .drop("_price", "_at", "_sku"))


# --- A8: stage flags / stage sets per session ---------------------------------
def stage_flag_aggs(spec: FunnelSpec = DEFAULT_SPEC) -> list[Column]:
    """One ``bool_or`` per hit stage: fixed-width partial state per session."""
    return [F.coalesce(F.bool_or(_code() == s.code), F.lit(False)).alias(s.flag)
            for s in spec.hit_stages]


def stage_flags(hits: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                key: str = "session_id") -> DataFrame:
    """session_id + one boolean per hit stage (true if any hit has the code)."""
    return hits.groupBy(key).agg(*stage_flag_aggs(spec))


def stage_sets(hits: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
               key: str = "session_id") -> DataFrame:
    """Array form of A8: sorted set of reached stage names per session.

    ``collect_set`` state is bounded by the number of stages, not by hits.
    Unmapped codes are dropped before grouping.
    """
    ev = stage_code_to_event(_code(), spec)
    return (hits.where(_code().isin(*spec.codes))
                .groupBy(key).agg(F.sort_array(F.collect_set(ev)).alias("stages")))


# --- A17: session totals from hits (+ fused flags) ----------------------------
def session_rollup(hits: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                   keys: Sequence[str] = ("session_id",), value_col: str | None = None,
                   with_flags: bool = False) -> DataFrame:
    """Session totals computed from hits in one aggregation.

    totals_pageviews = hits with the first stage's code; totals_hits = hits + 1
    (the hit counter starts at 1 and is bumped after each hit);
    totals_bounces = 1 for a single-hit session; totals_transactions = hits
    with the purchase code; totals_transactionRevenue = sum of ``value_col``
    over purchase hits in micros (NULL when none). With ``with_flags`` the A8
    stage flags come out of the same pass (one shuffle instead of two).
    """
    view, buy = spec.stages[0].code, spec.purchase.code
    n = F.count(F.lit(1))
    aggs = [
        F.count_if(_code() == view).cast("int").alias("totals_pageviews"),
        F.when(n == 1, 1).otherwise(0).alias("totals_bounces"),
        (n + 1).cast("int").alias("totals_hits"),
        F.count_if(_code() == buy).cast("int").alias("totals_transactions"),
    ]
    if value_col is not None:
        aggs.append(F.sum(F.when(_code() == buy, usd_to_micros(value_col)))
                    .alias("totals_transactionRevenue"))
    if with_flags:
        aggs += stage_flag_aggs(spec)
    return hits.groupBy(*keys).agg(*aggs)


# --- E9: dates that may not parse ------------------------------------------------
def tolerant_dates(sessions: DataFrame, date: str = "date") -> DataFrame:
    """Raw sessions with ``date`` parsed, NULL where it is no date: the operators below take such
    sessions as they are, and no row is lost and no job ends because of one cell."""
    if dict(sessions.dtypes)[date] == "date":
        return sessions
    return sessions.withColumn(date, parse_yyyymmdd(date, tolerant=True))


# --- M2: clean sessions -------------------------------------------------------
def clean_sessions(sessions: DataFrame, hits: DataFrame | None = None,
                   spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """One analysis row per session with a boolean flag per funnel stage.

    With ``hits`` the flags are aggregated from hits and left-joined (sessions
    without hits get false). Without ``hits`` the sessions must already carry
    the flag columns (from ``session_rollup(with_flags=True)``).
    ``purchased`` = transactions > 0 (NULL counts as 0); revenue = micros/1e6.
    """
    s = sessions
    hit_flags = [st.flag for st in spec.hit_stages]
    if hits is not None:
        s = s.drop(*[f for f in hit_flags if f in s.columns])
        s = s.join(stage_flags(hits, spec), "session_id", "left")
    date = F.col("date") if dict(s.dtypes).get("date") == "date" else parse_yyyymmdd("date")
    # Stage flags in spec order; a stage not derived from hits (the default
    # purchase stage) comes from the session's transaction count.
    flags = [F.coalesce(F.col(st.flag), F.lit(False)).alias(st.flag) if st.from_hits
             else (F.coalesce(F.col("totals_transactions"), F.lit(0)) > 0).alias(st.flag)
             for st in spec.stages]
    return s.select(
        F.col("session_id").cast("string").alias("session_id"),
        F.col("fullVisitorId").cast("string").alias("fullVisitorId"),
        date.alias("date"),
        F.col("channelGrouping").alias("channel"),
        F.col("deviceCategory").alias("device"),
        F.col("country"),
        F.col("totals_pageviews").cast("int").alias("pageviews"),
        *flags,
        micros_to_usd("totals_transactionRevenue").alias("revenue"),
        F.col("totals_transactionRevenue").cast("long").alias("revenue_micros"),
    )


def _session_dims(sessions: DataFrame) -> DataFrame:
    """session_id, channel, device, date(date) from raw or clean sessions."""
    if "channelGrouping" in sessions.columns:
        date = F.col("date") if dict(sessions.dtypes).get("date") == "date" else parse_yyyymmdd("date")
        return sessions.select("session_id", F.col("channelGrouping").alias("channel"),
                               F.col("deviceCategory").alias("device"), date.alias("date"))
    return sessions.select("session_id", "channel", "device", "date")


# --- J1 / J2: hits left-joined to session dimensions ---------------------------
def join_hits_sessions(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every hit with its session's channel, device and date (NULL if no session).

    Duplicate session ids fan out, as a left join does; the quality report
    counts them.
    """
    return hits.join(_session_dims(sessions), "session_id", "left")


# --- M3: purchase lines -------------------------------------------------------
def purchase_lines(hits: DataFrame, sessions: DataFrame,
                   spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per purchase hit; item_value is the unit price (no quantity)."""
    buys = hits.where(_code() == spec.purchase.code)
    j = join_hits_sessions(buys, sessions)
    return j.select("session_id", "date", "productSKU",
                    F.col("v2ProductCategory").alias("category"), "channel", "device",
                    F.col("productPrice").alias("item_value"))


# --- M4: long event log -------------------------------------------------------
def event_log(hits: DataFrame, sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Mapped hits only (unmapped codes dropped) with the stage name and dims.

    ``hitNumber`` is passed through when the hits carry it, else NULL.
    """
    mapped = hits.where(_code().isin(*spec.codes))
    j = join_hits_sessions(mapped, sessions)
    hit_no = F.col("hitNumber") if "hitNumber" in hits.columns else F.lit(None)
    return j.select("session_id", hit_no.cast("int").alias("hitNumber"),
                    stage_code_to_event(_code(), spec).alias("event_type"),
                    _code().alias(CODE), "productSKU", "v2ProductCategory",
                    "channel", "device", F.col("date").alias("event_date"))


# --- J5: sessions without hits ------------------------------------------------
def sessions_without_hits(sessions: DataFrame, hits: DataFrame) -> DataFrame:
    """Sessions whose id never occurs in hits (a NULL id matches a NULL id).

    Hit ids are de-duplicated first (map-side), so a hot session is one row
    before the anti join and cannot skew it.
    """
    ids = hits.select(F.col("session_id").alias("_hid")).distinct()
    return sessions.join(ids, sessions["session_id"].eqNullSafe(ids["_hid"]), "left_anti")


# --- A10: duplicate keys ------------------------------------------------------
def duplicate_keys(df: DataFrame, key: str = "session_id") -> DataFrame:
    """rows, distinct_keys, duplicate_rows (rows whose key was seen before).

    NULL keys form one group, as in pandas ``duplicated``.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def dedupe_sessions(sessions: DataFrame, key: str = "session_id",
                    order: Sequence[str] = ("visitId",)) -> DataFrame:
    """Opt-in: one row per key, the row with the smallest ``order`` values.

    Ties are broken by the whole row, so the choice is deterministic; the
    ``min_by`` aggregate combines map-side, so a key with many copies is never
    gathered in one task. The default pipeline keeps duplicates (and the
    quality report counts them).
    """
    cols = [c for c in sessions.columns if c != key]
    row = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(c) for c in order if c in sessions.columns], row)
    return (sessions.groupBy(key).agg(F.min_by(row, rank).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*sessions.columns))


# --- M1: data quality report --------------------------------------------------
def quality_report(sessions: DataFrame, hits: DataFrame, date: str | None = None) -> DataFrame:
    """sessions, hits, duplicate_session_ids, sessions_without_hits in one row; with ``date``, a column of
    yyyyMMdd text, also bad_dates (text that is no date) and missing_dates (NULL).

    One shuffle: sessions and hits are tagged, unioned and grouped by
    session_id (partial aggregation first), then reduced to one row. Null ids
    group together, matching pandas ``duplicated`` / ``isin``.
    """
    none = F.lit(0)
    missing = F.col(date).isNull().cast("int") if date else none
    bad = F.when(F.col(date).isNotNull() & parse_yyyymmdd(date, tolerant=True).isNull(), 1).otherwise(0) if date else none
    tagged = (sessions.select("session_id", F.lit(1).alias("_s"), none.alias("_h"), bad.alias("_b"), missing.alias("_m"))
              .unionByName(hits.select("session_id", none.alias("_s"), F.lit(1).alias("_h"), none.alias("_b"), none.alias("_m"))))
    per_key = tagged.groupBy("session_id").agg(F.sum("_s").alias("ns"), F.sum("_h").alias("nh"),
                                               *[F.sum(c).alias(c) for c in ("_b", "_m") if date])
    return per_key.agg(
        F.coalesce(F.sum("ns"), F.lit(0)).cast("long").alias("sessions"),
        F.coalesce(F.sum("nh"), F.lit(0)).cast("long").alias("hits"),
        F.coalesce(F.sum(F.greatest(F.col("ns") - 1, F.lit(0))), F.lit(0)).cast("long")
         .alias("duplicate_session_ids"),
        F.coalesce(F.sum(F.when(F.col("nh") == 0, F.col("ns"))), F.lit(0)).cast("long")
         .alias("sessions_without_hits"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
          for c, name in (("_b", "bad_dates"), ("_m", "missing_dates")) if date])


# --- M7: action-code profile --------------------------------------------------
def action_counts(hits: DataFrame) -> DataFrame:
    return (hits.groupBy(CODE).agg(F.count(F.lit(1)).alias("hits"))
                .orderBy(F.col(CODE).asc_nulls_first()))


# --- M6: processed-output summary ---------------------------------------------
def pipeline_summary(sessions: DataFrame, purchases: DataFrame, events: DataFrame,
                     spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Row counts of the three outputs, overall conversion and total revenue.

    The three inputs are tagged and unioned into one global aggregate (no
    cross join of one-row frames).
    """
    empty_i, empty_l = F.lit(None).cast("int"), F.lit(None).cast("long")
    u = (sessions.select(F.lit(0).alias("_src"), F.col(spec.purchase.flag).cast("int").alias("_p"),
                         F.col("revenue_micros").alias("_m"))
         .unionByName(purchases.select(F.lit(1).alias("_src"), empty_i.alias("_p"), empty_l.alias("_m")))
         .unionByName(events.select(F.lit(2).alias("_src"), empty_i.alias("_p"), empty_l.alias("_m"))))
    return u.agg(
        F.count_if(F.col("_src") == 0).alias("sessions_rows"),
        F.count_if(F.col("_src") == 1).alias("purchases_rows"),
        F.count_if(F.col("_src") == 2).alias("events_rows"),
        ratio(flag_count(F.col("_p") == 1), F.count_if(F.col("_src") == 0)).alias("overall_conversion"),
        (sum_micros("_m").cast("double") / 1e6).alias("total_revenue"))
