"""A funnel whose stages are data.

The stages are a table (code, stage, stage_order) that is met at run time, not a
``FunnelSpec``. Hits meet it in a join that Spark sizes: it is broadcast while small, and
split where a code is hot otherwise. Each hit becomes one bit, the one of its stage, and
a session's bits are united by ``bit_or``, which combines map-side. So a session's
state is one number whatever the number of stages, up to ``MAX_STAGES``.

Hits whose code no stage has are dropped (F2). A code that two stages have, a stage
order that occurs twice, is out of range or NULL, ends the job with its value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

#: Bits of a mask of a session's stages.
MAX_STAGES = 62
CODE = "eCommerceAction_action_type"


def _refuse(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(message), F.coalesce(value.cast("string"), F.lit("NULL")))).cast("long"))


def guarded_stages(stages: DataFrame, code: str = "code", name: str = "stage", order: str = "stage_order") -> DataFrame:
    """(code, stage, stage_order), one row per code, with the guards of the module in the plan.

    Windows by code and by order: a stage table is small, and no task needs more than the rows of one value.
    """
    rows = stages.select(F.col(code).cast("int").alias("code"), F.col(name).cast("string").alias("stage"),
                         F.col(order).cast("long").alias("stage_order"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("code")) > 1
    same = F.count(F.lit(1)).over(Window.partitionBy("stage_order")) > 1
    at = F.col("stage_order")
    guard = F.coalesce(
        _refuse(twice & F.col("code").isNotNull(), "two stages have the code ", F.col("code")),
        _refuse(same, "two stages have the order ", at),
        _refuse(at.isNull() | (at < 1) | (at > MAX_STAGES), f"a stage order must be from 1 to {MAX_STAGES}, not ", at), at)
    return rows.withColumn("stage_order", guard)


def _bit(order: str | Column) -> Column:
    at = F.col(order) if isinstance(order, str) else order
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at - 1).cast("int"))


def stage_masks(hits: DataFrame, stages: DataFrame, key: str = "session_id", code: str = CODE) -> DataFrame:
    """(key, mask): the stages of which the session has any hit, as bits."""
    table = guarded_stages(stages).where(F.col("code").isNotNull()).select(
        F.xxhash64("code").alias("_at"), F.col("code").alias("_code"), _bit("stage_order").alias("_bit"))
    # a join on a hash: both sides are exchanged beyond the broadcast size, and a hot code can be split
    mapped = hits.select(F.col(key), F.col(code).cast("int").alias("_hit"), F.xxhash64(F.col(code).cast("int")).alias("_at")) \
        .where(F.col("_hit").isNotNull()).join(table, "_at").where("_hit = _code")
    return mapped.groupBy(key).agg(F.bit_or("_bit").alias("mask"))


def with_masks(sessions: DataFrame, masks: DataFrame, key: str = "session_id", totals: dict[int, Column] | None = None) -> DataFrame:
    """Sessions with their ``mask``, 0 without mapped hits. ``totals`` adds stages that do not come from hits:
    by their order, the condition on a session's own columns."""
    own = F.lit(0).cast("long")
    for order, reached in (totals or {}).items():
        own = own.bitwiseOR(F.when(F.coalesce(reached, F.lit(False)), _bit(F.lit(order))).otherwise(F.lit(0).cast("long")))
    return sessions.join(masks, key, "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")).bitwiseOR(own))


def stage_funnel(masked: DataFrame, stages: DataFrame, by: Sequence[str] = (), entry: str = "Sessions") -> DataFrame:
    """The funnel frame of a stage table: stage, stage_order, count, pct_of_sessions, step_conv, per segment.

    Sessions are counted by mask first; only that small table is expanded into stages. A stage that no
    session reached has count 0. Without sessions and segments there is the entry row with count 0 and each stage with 0.
    """
    table = guarded_stages(stages).select("stage", "stage_order")
    counts = masked.groupBy(*by, "mask").agg(F.count(F.lit(1)).alias("n"))
    bits = F.filter(F.sequence(F.lit(1), F.lit(MAX_STAGES)), lambda i: F.col("mask").bitwiseAND(_bit(i)) != 0)
    reached = counts.select(*by, "n", F.explode(F.concat(F.array(F.lit(0)), bits)).alias("stage_order"))
    reached = reached.groupBy(*by, F.col("stage_order").cast("long").alias("stage_order")).agg(F.sum("n").alias("n"))
    # every segment gets every stage: the list of stages is one small array, so this is no product of tables
    listed = table.unionByName(masked.sparkSession.createDataFrame([(entry, 0)], "stage string, stage_order long"))
    whole = listed.groupBy(F.lit(1).alias("_one")).agg(F.sort_array(F.collect_list(F.struct("stage_order", "stage"))).alias("_all"))
    segments = (counts.select(*by).distinct().withColumn("_one", F.lit(1)) if by else
                masked.sparkSession.range(1).select(F.lit(1).alias("_one")))
    frame = segments.join(whole, "_one").select(*by, F.inline("_all"))
    same = F.col("f.stage_order") == F.col("r.stage_order")
    for c in by:
        same = same & F.col(f"f.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    long = frame.alias("f").join(reached.alias("r"), same, "left").select(
        *[F.col(f"f.`{c}`").alias(c) for c in by], "f.stage", F.col("f.stage_order").cast("int").alias("stage_order"),
        F.coalesce("r.n", F.lit(0)).cast("long").alias("count"))
    window = Window.partitionBy(*by, F.lit(1)).orderBy("stage_order")   # a segment's stages, never sessions
    first = F.first("count").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return long.select(*by, "stage", "stage_order", "count", ratio("count", first).alias("pct_of_sessions"),
                       ratio("count", F.lag("count").over(window)).alias("step_conv"))
