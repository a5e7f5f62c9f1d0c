"""Streaming extension: the funnel over an unbounded hit stream.

The batch pipeline has no streams; this is an extension built with
Structured Streaming only. Sessions are event-time session windows (an
inactivity gap closes a session) per visitor, with the watermark bounding the
state kept for open sessions. Closed sessions can feed a chained daily
rollup (the daily trend), emitted once the watermark passes the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import flag_count, ratio, sum_micros, usd_to_micros
from ..spec import DEFAULT_SPEC, MICROS, FunnelSpec

CODE = "eCommerceAction_action_type"


def sessionize_stream(hits: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, gap: str = "30 minutes",
                      watermark: str = "1 hour", visitor: str = "user_id", ts: str = "ts",
                      value_col: str | None = "value") -> DataFrame:
    """One row per (visitor, session window): hit count and stage flags.

    Works on batch frames too (same session_window semantics), which is how
    the tests check the stream. ``purchased`` = at least one purchase hit.
    """
    code = F.col(CODE)
    aggs = [F.count(F.lit(1)).alias("hits")]
    aggs += [F.coalesce(F.bool_or(code == st.code), F.lit(False)).alias(st.flag) for st in spec.hit_stages]
    aggs.append(F.count_if(code == spec.purchase.code).alias("transactions"))
    if value_col is not None:
        aggs.append(F.sum(F.when(code == spec.purchase.code, usd_to_micros(value_col))).alias("revenue_micros"))
    src = hits.withWatermark(ts, watermark) if hits.isStreaming else hits
    s = src.groupBy(F.session_window(ts, gap).alias("session_window"), visitor).agg(*aggs)
    return s.withColumn(spec.purchase.flag, F.col("transactions") > 0)


def daily_trend_stream(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """date, sessions, orders, revenue, conversion_rate from closed sessions.

    Chained stateful aggregation: a session counts on the day its window
    ends (``window_time``); a day is emitted in append mode once closed.
    """
    day = F.window(F.window_time("session_window"), "1 day")
    agg = sessions.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"), flag_count(spec.purchase.flag).alias("orders"),
        sum_micros("revenue_micros").alias("revenue_micros"))
    return agg.select(F.col("day.start").cast("date").alias("date"), "sessions", "orders",
                      (F.col("revenue_micros").cast("double") / MICROS).alias("revenue"),
                      ratio("orders", "sessions").alias("conversion_rate"))


def start(df: DataFrame, name: str, checkpoint_location: str, sink: str, output_mode: str = "append",
          path: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a query. ``checkpoint_location`` is where a restart goes on, so it
    must stay the same and lie on shared storage; ``sink`` names a format (the
    ``memory`` sink keeps its whole output in the driver and is for tests)."""
    w = (df.writeStream.queryName(name).outputMode(output_mode).format(sink)
         .option("checkpointLocation", checkpoint_location))
    if path:
        w = w.option("path", path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
