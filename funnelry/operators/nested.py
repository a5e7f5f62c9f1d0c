"""Nested session records (one row per session with a repeated ``hits`` array).

``flatten_nested`` (M5) is the nested counterpart of ``clean_sessions``: stage
flags come from the higher-order ``exists`` over the array (J7), without an
explode. ``to_nested_sessions`` builds the nested shape from flat tables. It
cuts a session into records by a bucket of its hits, so that no array holds
more than the hits of a bucket; such records share a ``record_id`` and
``flatten_nested`` puts them together again. Records without a ``record_id``
(a plain export) are sessions of their own and are never merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros_to_usd, parse_yyyymmdd
from ..spec import DEFAULT_SPEC, FunnelSpec

FRAGMENT, RECORD = "hit_fragment", "record_id"

SESSION_FIELDS = ("fullVisitorId", "visitId", "date", "channelGrouping", "deviceCategory", "country",
                  "totals_pageviews", "totals_transactions", "totals_transactionRevenue")


def to_nested_sessions(raw_sessions: DataFrame, hits: DataFrame, bucket: Column,
                       order: Sequence[str] = ("hitNumber",)) -> DataFrame:
    """Raw flat sessions + hits -> nested records, one per session and bucket.

    ``bucket`` is an integer that never decreases along ``order`` within a
    session, e.g. the hour of the hit; it bounds the arrays. Arrays follow
    ``order``. Sessions without hits get one record with an empty array, hits
    without a session are dropped, and each row of a repeated session id keeps
    its own record with its own fields.

    Two shuffles: arrays are gathered per (session, bucket), and joined to the
    sessions, a join that adaptive execution can split for a hot session.
    """
    number = F.col("hitNumber") if "hitNumber" in hits.columns else F.lit(None)
    element = F.struct(number.cast("int").alias("hitNumber"),
                       F.struct(F.col("eCommerceAction_action_type").cast("string").alias("action_type"))
                       .alias("eCommerceAction"))
    placed = F.struct(*[F.col(c) for c in order], element.alias("_hit"))
    arrays = (hits.select("session_id", bucket.cast("int").alias(FRAGMENT), placed.alias("h"))
              .groupBy("session_id", FRAGMENT)
              .agg(F.transform(F.sort_array(F.collect_list("h")), lambda h: h["_hit"]).alias("hits")))
    fields = F.struct(*[F.col(c) for c in SESSION_FIELDS])
    s = raw_sessions.select("session_id", F.concat_ws("/", "session_id", F.xxhash64(fields).cast("string")).alias(RECORD),
                            *SESSION_FIELDS).join(arrays, "session_id", "left")
    return s.select(
        "fullVisitorId", "visitId", "date", "channelGrouping",
        F.struct(F.col("deviceCategory").alias("deviceCategory")).alias("device"),
        F.struct(F.col("country").alias("country")).alias("geoNetwork"),
        F.struct(F.col("totals_pageviews").alias("pageviews"),
                 F.col("totals_transactions").alias("transactions"),
                 F.col("totals_transactionRevenue").alias("transactionRevenue")).alias("totals"),
        F.coalesce("hits", F.array().cast(arrays.schema["hits"].dataType)).alias("hits"),
        F.coalesce(FRAGMENT, F.lit(0)).alias(FRAGMENT), RECORD)


def exists_flags(nested: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> list:
    """One boolean per hit stage: any array element with the stage's code.

    Codes are strings in the nested export. An empty or NULL array, or a NULL
    element, gives false (``coalesce`` over ``exists``). These are flags of a
    record; ``flatten_nested`` gives those of a session.
    """
    return [F.coalesce(F.exists("hits", _has_code(str(st.code))), F.lit(False)).alias(st.flag)
            for st in spec.hit_stages]


def _has_code(code: str):
    return lambda h: h["eCommerceAction"]["action_type"] == F.lit(code)


def flatten_nested(nested: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, date_from: str | None = None,
                   date_to: str | None = None) -> DataFrame:
    """M5: one flagged row per nested session, keyed ``fullVisitorId-visitId``.

    ``date_from``/``date_to`` (yyyyMMdd, inclusive) filter the ``date``
    column; on a date-partitioned layout this prunes partitions. Records that
    share a ``record_id`` are one session: its fields come from one record
    whole, its flags are true if they are in any. All other records stay rows
    of their own, whether ids repeat or not: a plain projection, without any
    shuffle and without a key of their own.
    """
    n = nested
    if date_from is not None or date_to is not None:
        n = n.where(F.col("date").between(F.lit(date_from or "00000000"), F.lit(date_to or "99999999")))
    fields = {
        "session_id": F.concat(F.col("fullVisitorId"), F.lit("-"), F.col("visitId").cast("string")),
        "fullVisitorId": F.col("fullVisitorId"),
        "date": F.col("date") if dict(n.dtypes)["date"] == "date" else parse_yyyymmdd("date"),
        "channel": F.col("channelGrouping"),
        "device": F.col("device.deviceCategory"),
        "country": F.col("geoNetwork.country"),
        "pageviews": F.col("totals.pageviews"),
        spec.purchase.flag: F.coalesce(F.col("totals.transactions"), F.lit(0)) > 0,
        "revenue": micros_to_usd("totals.transactionRevenue"),
        "revenue_micros": F.col("totals.transactionRevenue"),
    }
    hit_flags = [st.flag for st in spec.hit_stages]
    cols = ["session_id", "fullVisitorId", "date", "channel", "device", "country", "pageviews", *hit_flags,
            spec.purchase.flag, "revenue", "revenue_micros"]
    named = [c.alias(k) for k, c in fields.items()]
    plain = n if RECORD not in nested.columns else n.where(F.col(RECORD).isNull())
    alone = plain.select(*named, *exists_flags(n, spec)).select(*cols)
    if RECORD not in nested.columns:
        return alone
    whole = n.where(F.col(RECORD).isNotNull()).select(RECORD, F.struct(*named).alias("s"), *exists_flags(n, spec)) \
        .groupBy(RECORD).agg(F.max("s").alias("s"), *[F.bool_or(f).alias(f) for f in hit_flags])
    return alone.unionByName(whole.select(*[F.col(f"s.{k}").alias(k) for k in fields], *hit_flags).select(*cols))
