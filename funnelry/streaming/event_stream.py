"""Streaming extension: the event log and the duplicate report over unbounded input.

``event_log_stream`` joins a stream of hits to a stream of sessions (J2, M4). A hit waits for its
session, and a session for its hits, no longer than ``span`` and the watermarks allow; then
their state goes, and a hit whose session has not come is given with NULLs, as a left join gives
it. ``unique_hits`` drops repeats of a hit that arrive within the watermark (A10, M1), and
``stream_counts`` tells from a query's progress how many repeats and late rows went. All take batch frames too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import stage_code_to_event
from ..spec import DEFAULT_SPEC, FunnelSpec

CODE = "eCommerceAction_action_type"


def _watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def event_log_stream(hits: DataFrame, sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, ts: str = "ts",
                     session_ts: str = "session_ts", span: str = "1 day", watermark: str = "1 hour",
                     session_watermark: str = "1 hour") -> DataFrame:
    """The event log's columns and ``ts``: mapped hits with their session's channel, device and date.

    ``sessions`` has session_id, channel, device, date and ``session_ts``, the start of the session; a hit
    belongs to the session of its id that started within ``span`` before it.
    """
    mapped = _watermarked(hits.where(F.col(CODE).isin(*spec.codes)), ts, watermark).alias("h")
    dims = _watermarked(sessions.select(F.col("session_id").alias("_sid"), "channel", "device", "date",
                                        F.col(session_ts).alias("_start")), "_start", session_watermark).alias("s")
    near = F.expr(f"session_id = _sid AND {ts} >= _start AND {ts} < _start + INTERVAL {span}")
    number = F.col("hitNumber") if "hitNumber" in hits.columns else F.lit(None)
    return mapped.join(dims, near, "leftOuter").select(
        "session_id", number.cast("int").alias("hitNumber"), stage_code_to_event(CODE, spec).alias("event_type"), CODE,
        "productSKU", "v2ProductCategory", "channel", "device", F.col("date").alias("event_date"), ts)


def unique_hits(hits: DataFrame, key: str = "event_id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Hits without repeats of ``key``. On a stream a repeat is known as long as the watermark
    has not passed the first one by, so state is bounded; on a batch frame all repeats go."""
    if not hits.isStreaming:
        return hits.dropDuplicates([key])
    return hits.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


@dataclass(frozen=True)
class StreamCounts:
    rows: int               # read
    duplicate_rows: int     # dropped as repeats
    late_rows: int          # dropped behind the watermark, before any operator saw them
    state_rows: int         # held after the last batch
    most_state_rows: int    # held after any batch


def stream_counts(query: StreamingQuery) -> StreamCounts:
    """Counts over the batches that the query's recent progress holds
    (``spark.sql.streaming.numRecentProgressUpdates``, 100 by default)."""
    rows = duplicates = late = 0
    state = [0]
    for p in query.recentProgress:
        rows += p["numInputRows"]
        state.append(sum(op["numRowsTotal"] for op in p["stateOperators"]))
        for op in p["stateOperators"]:
            late += op["numRowsDroppedByWatermark"]
            duplicates += op.get("customMetrics", {}).get("numDroppedDuplicateRows", 0)
    return StreamCounts(rows, duplicates, late, state[-1], max(state))
