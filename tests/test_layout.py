"""K4: an order in which device alone, channel alone and one session id each skip most row groups."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from funnelry.sinks import writers


def _rows_scanned(spark, frame):
    """Rows that the scan hands on: row groups that are skipped give none."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = frame.select("session_id")
        done.collect()
        node = done._jdf.queryExecution().executedPlan()
        while not node.nodeName().startswith("Scan"):
            node = node.children().head()
        return node.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_each_filter_alone_skips_most_row_groups(spark, tmp_path):
    n, path = 64_000, str(tmp_path / "layout")
    rows = spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("session_id"), F.concat(F.lit("d"), F.col("id") % 8).alias("device"),
        F.concat(F.lit("c"), F.floor(F.col("id") / 8) % 8).alias("channel"), F.rand(1).alias("revenue"))
    writers.write_interleaved(rows, path, files=16, row_group_bytes=1 << 18)
    back = spark.read.parquet(path)
    assert back.columns == rows.columns and back.exceptAll(rows).count() == 0 and back.count() == n
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in sorted((tmp_path / "layout").glob("*.parquet"))
              for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) >= 16
    for column, place, value in (("device", 1, "d3"), ("channel", 2, "c5")):
        hit = [g for g in groups if g.column(place).statistics.min <= value <= g.column(place).statistics.max]
        assert len(hit) <= 0.4 * len(groups), column
        assert _rows_scanned(spark, back.where(F.col(column) == value)) <= 0.4 * n
        assert back.where(F.col(column) == value).count() == n // 8
    one = rows.first().session_id
    assert _rows_scanned(spark, back.where(F.col("session_id") == one)) <= 0.25 * n
    assert back.where(F.col("session_id") == one).count() == 1


def test_nulls_one_value_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, "x"), ("b", "d", None), ("c", None, "x"), (None, "d", "x")],
                                 "session_id string, device string, channel string")
    for i, frame in enumerate((rows, rows.limit(0), rows.withColumn("device", F.lit("same")))):
        writers.write_interleaved(frame, f"{tmp_path}/{i}", files=2)
        back = spark.read.schema(frame.schema).parquet(f"{tmp_path}/{i}")
        assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    places = {r.value: r.place for r in writers.range_places(rows, "device", bits=2).collect()}
    assert places == {None: 0, "d": 2}
