"""M28, M17, K5 by day: stored counts that add up, so that a changed day costs a day.

The state of a day is its sessions counted by device and channel, and its purchase lines counted by
category: counts and integer micros, which add up exactly. It is stored with a partition
per day. When a day changes, that day alone is counted and written; the cube and the six
extracts come from the sum of all days' states, a table that does not grow with the sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio, sum_micros, usd_to_micros
from ..spec import DEFAULT_SPEC, MICROS, FunnelSpec
from . import reports

DIMS = ("device", "channel", "date")


def session_state(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Sessions counted by day, device and channel."""
    return reports.cube_base(sessions, spec, DIMS)


def purchase_state(purchases: DataFrame) -> DataFrame:
    """Purchase lines counted by day and category: orders, priced lines and micros."""
    return purchases.groupBy("date", "category").agg(
        F.count("session_id").alias("orders"), F.count("item_value").alias("priced"),
        sum_micros(usd_to_micros("item_value")).alias("micros"))


def _days(days: Sequence[str] | None) -> Column:
    return F.lit(True) if days is None else F.col("date").isin(*[F.to_date(F.lit(d), "yyyyMMdd") for d in days])


def _emptied(rows: DataFrame, state: DataFrame, days: Sequence[str] | None) -> DataFrame:
    """With a row of zeros for each of ``days``: a day that has no rows any more gets an empty state, not its old one."""
    if days is None:
        return state
    day = rows.sparkSession.createDataFrame([(d,) for d in days], "d string")
    zero = day.select(*[F.to_date("d", "yyyyMMdd").alias(f.name) if f.name == "date" else
                        (F.lit(0) if f.dataType.simpleString() == "bigint" else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in state.schema.fields])
    return state.unionByName(zero)


def write_state(sessions: DataFrame, purchases: DataFrame, root: str, days: Sequence[str] | None = None,
                spec: FunnelSpec = DEFAULT_SPEC) -> None:
    """Counts the rows of ``days`` (yyyyMMdd; all if None) and replaces those days' partitions, and no others."""
    for name, rows, count in (("sessions", sessions, lambda r: session_state(r, spec)), ("purchases", purchases, purchase_state)):
        chosen = rows.where(_days(days))
        state = _emptied(chosen, count(chosen), days)
        state.withColumn("day", F.date_format("date", "yyyyMMdd")).repartition("day").write.mode("overwrite") \
            .option("partitionOverwriteMode", "static" if days is None else "dynamic") \
            .partitionBy("day").parquet(f"{root.rstrip('/')}/{name}")


def read_state(spark: SparkSession, root: str, date_from: str | None = None, date_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored states of sessions and purchases; a range of days reads those partitions alone."""
    from ..sources.files import date_range

    both = (spark.read.option("inferSchema", False).parquet(f"{root.rstrip('/')}/{n}") for n in ("sessions", "purchases"))
    first, second = (date_range(s, date_from, date_to, "day").drop("day") for s in both)
    return first, second


def merged_cube(state: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """The metric cube from states of any days."""
    names = [c for c in state.columns if c not in DIMS]
    whole = state.groupBy(*DIMS).agg(*[F.sum(c).alias(c) for c in names]).where("sessions > 0")
    return reports.expand_cube(whole, spec, reports.CUBE_SETS, DIMS)


def merged_category_revenue(state: DataFrame) -> DataFrame:
    """The category table from states of any days."""
    whole = state.groupBy("category").agg(*[F.sum(c).cast("long").alias(c) for c in ("orders", "priced", "micros")]) \
        .where("orders > 0 OR priced > 0")
    return whole.select("category", "orders", (F.col("micros").cast("double") / MICROS).alias("revenue"),
                        (ratio("micros", "priced") / MICROS).alias("avg_item_value")) \
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("category"))


def extracts_from_state(spark: SparkSession, root: str, spec: FunnelSpec = DEFAULT_SPEC, date_from: str | None = None,
                        date_to: str | None = None) -> dict[str, DataFrame]:
    """The six dashboard tables from the stored states."""
    from ..sinks.writers import dashboard_tables

    sessions, purchases = read_state(spark, root, date_from, date_to)
    return dashboard_tables(merged_cube(sessions, spec), None, spec, category=merged_category_revenue(purchases))

