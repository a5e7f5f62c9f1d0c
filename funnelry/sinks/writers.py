"""Sinks: CSV extracts (K1), JSON findings document (K2), tables (K3),
partitioned session layout (K4) and the dashboard extract publish (K5).

All writes overwrite their target. Large tables are written in parallel (one
file per task); ``single_file`` is only for small aggregates.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators import funnel, reports
from ..session import Scratch, materialize
from ..spec import DEFAULT_SPEC, FunnelSpec


# --- K1 -----------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header. ``single_file`` coalesces to one task: small data only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                  sort_within: Sequence[str] = ()) -> None:
    out = df
    if partition_by:
        # Rows of one partition value go to few tasks (few files); AQE splits
        # a hot value (one huge day) across tasks and merges small ones.
        out = out.hint("rebalance", *partition_by)
    if sort_within:
        # Partition columns first: the writer needs that order, and would
        # otherwise sort again by them alone.
        out = out.sortWithinPartitions(*partition_by, *sort_within)
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# --- K2 -----------------------------------------------------------------------
def to_json_document(doc: DataFrame) -> DataFrame:
    """One JSON string per row; NULL fields are kept (written as null)."""
    return doc.select(F.to_json(F.struct(*doc.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_document(doc: DataFrame, path: str) -> None:
    """Findings-style document: a one-row frame written as one JSON line."""
    to_json_document(doc).coalesce(1).write.mode("overwrite").text(path)


# --- K3 / K4 ------------------------------------------------------------------
def save_table(df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = (),
               sort_within: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    """Overwrite a Parquet table in the catalog (the relational sink).

    ``bucket_by`` + ``buckets``: tables bucketed on the same key with the same
    bucket count join and aggregate on that key without a shuffle (e.g.
    sessions, purchases and the event log on ``session_id``).
    """
    out = df.sortWithinPartitions(*partition_by, *sort_within) if sort_within and not bucket_by else df
    w = out.write.mode("overwrite").format("parquet")
    if bucket_by:
        w = w.bucketBy(buckets, *bucket_by)
        if sort_within:
            w = w.sortBy(*sort_within)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def save_relational_tables(sessions: DataFrame, purchases: DataFrame, database: str | None = None,
                           buckets: int = 0, spec: FunnelSpec = DEFAULT_SPEC) -> dict[str, str]:
    """Catalog tables ``sessions`` and ``purchases`` for SQL users (K3).

    Flags are 0/1 integers (SQL ``SUM`` works on them), purchases carry
    ``revenue`` as the unit price as well as ``item_value``. With ``buckets``
    both tables are bucketed on ``session_id`` (joins between them need no
    shuffle) and sessions are sorted by device and channel inside each bucket,
    so segment filters skip row groups (K4, in place of secondary indexes).
    """
    from ..plans.sql import purchases_view, sessions_view
    prefix = f"{database}." if database else ""
    names = {"sessions": f"{prefix}sessions", "purchases": f"{prefix}purchases"}
    bucket = ("session_id",) if buckets else ()
    save_table(sessions_view(sessions, spec), names["sessions"], bucket_by=bucket, buckets=buckets,
               sort_within=("device", "channel"))
    save_table(purchases_view(purchases).withColumn("revenue", F.col("item_value")), names["purchases"],
               bucket_by=bucket, buckets=buckets)
    return names


def write_sessions_layout(sessions: DataFrame, path: str) -> None:
    """Sessions partitioned by date, rows sorted by device then channel.

    The access path for segment filters: date predicates prune directories,
    device/channel predicates skip row groups by Parquet min/max statistics.
    """
    write_parquet(sessions, path, partition_by=("date",), sort_within=("device", "channel"))


def write_day_tables(df: DataFrame, root: str, day: str = "date", prefix: str = "ga_sessions_", fmt: str = "parquet") -> list[str]:
    """One table a day (``<prefix>yyyyMMdd``), from one job; gives the days written.

    All days are written into a staging folder first. Only when that has succeeded do its
    folders take their places, each in one rename; a day's former table goes just before. Rows
    without a day (not eight digits) are an error, before anything is changed.
    """
    spark = df.sparkSession
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    text = F.col(day).cast("string")
    checked = F.when(text.rlike("^[0-9]{8}$"), text).otherwise(F.raise_error(F.concat(F.lit("not a day: "), F.coalesce(text, F.lit("NULL")))))
    df.withColumn("_day", checked).hint("rebalance", "_day").write.partitionBy("_day").format(fmt).save(staging)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(s.getPath().getName().removeprefix("_day=") for s in fs.listStatus(at(staging)) if s.isDirectory())
    for d in days:
        target = at(f"{root.rstrip('/')}/{prefix}{d}")
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(at(f"{staging}/_day={d}"), target):
            raise OSError(f"{target} could not be put in place; the rest is in {staging}")
    fs.delete(at(staging), True)
    return days


#: Bits of a column's place in an interleaved key, and rows of a row group, small enough to be skipped one by one.
PLACE_BITS, ROW_GROUP_BYTES = 8, 8 << 20


def range_places(df: DataFrame, column: str, bits: int = PLACE_BITS) -> DataFrame:
    """(value, place): the column's values in order, dealt into 2^bits ranges of about equally many rows.

    For columns with few values next to the rows, such as segments: the values are counted first, and only
    the counts are put in order.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(1))
    share = F.coalesce(F.sum("n").over(before), F.lit(0)) * (1 << bits) / F.sum("n").over(total)
    return counts.select("value", F.floor(share).cast("long").alias("place"))


def write_interleaved(df: DataFrame, path: str, columns: Sequence[str] = ("device", "channel"), point: str | None = "session_id",
                      files: int | None = None, bits: int = PLACE_BITS, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """K4: an order that serves each of ``columns`` alone. Rows lie by the interleaved bits of the columns'
    places, so every row group holds a narrow range of each, and a filter on any of them skips by
    Parquet's minima and maxima. A Bloom filter on ``point`` serves lookups of one value of it.
    """
    rows = df
    for i, c in enumerate(columns):
        places = range_places(df, c, bits).select(F.col("value").alias(f"_v{i}"), F.col("place").alias(f"_p{i}"))
        rows = rows.join(places, F.col(f"`{c}`").eqNullSafe(F.col(f"_v{i}")), "left")
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for i in range(len(columns)):
            one = F.call_function("shiftright", F.col(f"_p{i}"), F.lit(bit)).bitwiseAND(F.lit(1))
            key = key.bitwiseOR(F.call_function("shiftleft", one, F.lit(bit * len(columns) + len(columns) - 1 - i)))
    rows = rows.withColumn("_key", key)
    order = ["_key", *columns]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    w = dealt.sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite") \
        .option("parquet.block.size", row_group_bytes)
    if point is not None:
        w = w.option(f"parquet.bloom.filter.enabled#{point}", "true")
    w.parquet(path)


# --- K5: dashboard extracts ---------------------------------------------------
EXTRACTS = ("funnel_stage", "funnel_by_device", "channel_performance", "device_channel_matrix",
            "daily_trend", "category_revenue")
#: Extracts of a fixed few rows; the others have a row per day or category and are written in parallel.
ONE_FILE = ("funnel_stage", "funnel_by_device", "channel_performance", "device_channel_matrix")


def dashboard_tables(cube: DataFrame, purchases: DataFrame | None, spec: FunnelSpec = DEFAULT_SPEC,
                     category: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six dashboard tables, five of them read from the one metric cube; ``category``
    is the sixth where it is at hand already."""
    total = reports.cube_grain(cube, reports.LEVEL_TOTAL, ())
    stage_cols = ["sessions", *spec.count_names[:-1], "orders"]
    stages = total.select(F.inline(F.array(*[
        F.struct(F.lit(lbl).alias("stage"), F.col(c).alias("sessions"), F.lit(i).alias("stage_order"))
        for i, (lbl, c) in enumerate(zip(spec.labels, stage_cols))])))
    dev = reports.cube_grain(cube, reports.LEVEL_DEVICE, ("device",)).select(
        "device", "sessions", *spec.count_names[:-1], F.col("orders").alias(spec.count_names[-1]), "revenue")
    ch = reports.cube_grain(cube, reports.LEVEL_CHANNEL, ("channel",)).select(
        "channel", "sessions", "orders", "revenue", "conversion_rate",
        ratio("revenue", "sessions").alias("revenue_per_session"))
    mat = reports.cube_grain(cube, reports.LEVEL_MATRIX, ("device", "channel")).select(
        "device", "channel", "sessions", "orders", "conversion_rate")
    daily = reports.cube_grain(cube, reports.LEVEL_DATE, ("date",)).select(
        "date", "sessions", "orders", "revenue", "conversion_rate")
    return {"funnel_stage": stages, "funnel_by_device": dev.orderBy("device"),
            "channel_performance": ch.orderBy("channel"), "device_channel_matrix": mat.orderBy("device", "channel"),
            "daily_trend": daily.orderBy("date"), "category_revenue": funnel.category_revenue(purchases) if category is None else category}


def publish_extracts(spark: SparkSession, sessions: DataFrame, purchases: DataFrame, out_dir: str,
                     fmt: str = "csv", spec: FunnelSpec = DEFAULT_SPEC) -> dict[str, str]:
    """Compute the metric cube once, persist it, and write the six extracts.

    The cube (one scan of sessions, GROUPING SETS) is written to the shared
    checkpoint folder first: each extract then reads that small table instead
    of re-scanning sessions, and a lost executor only recomputes from it.
    """
    written = {}
    with Scratch(spark) as scratch:
        cube = materialize(reports.metric_cube(sessions, spec), "metric-cube", scratch)
        for name, df in dashboard_tables(cube, purchases, spec).items():
            path = f"{out_dir.rstrip('/')}/{name}"
            if fmt == "csv":
                write_csv(df, path, single_file=name in ONE_FILE)
            else:
                df.write.mode("overwrite").parquet(path)
            written[name] = path
    return written
