"""The sequence number equals row_number() whatever the keys and the buckets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry.operators.sequence import sequence_within
from funnelry.sources import testdata


def _expected(df):
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))


def _rows(df):
    return sorted((r.id, r.seq) for r in df.select("id", "seq").collect())


def test_hot_key_is_spread_over_tasks(spark):
    hot = spark.range(20000).select(F.lit("hot").alias("k"), (F.col("id") % 97).alias("t"), "id")
    cold = spark.range(20000, 20600).select((F.col("id") % 150).cast("string").alias("k"), (F.col("id") % 7).alias("t"), "id")
    nulls = spark.range(30000, 30050).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("t"), "id")
    df = hot.unionByName(cold).unionByName(nulls)
    got = sequence_within(df, ["k"], ["t", "id"], F.col("t"), name="seq")
    assert _rows(got) == _rows(_expected(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 10000


def test_keys_with_null_and_beyond_doubles(spark):
    big = 2 ** 53
    rows = [(k, t, i) for i, (k, t) in enumerate([(big, 1), (big + 1, 1), (None, 2), (big, None), (None, None), (big + 1, 0),
                                                  (big, 1), (None, 2)])]
    df = spark.createDataFrame(rows, "k long, t int, id long")
    got = sequence_within(df, ["k"], ["t", "id"], F.col("t"), name="seq")
    assert _rows(got) == _rows(_expected(df))
    assert sorted(map(str, (r.k for r in got.collect()))) == sorted(map(str, (r[0] for r in rows)))


def test_bucket_of_one_instant_by_id_range(spark):
    df = spark.range(1000).select(F.lit("bot").alias("k"), F.lit(5).alias("t"), "id")
    got = sequence_within(df, ["k"], ["t", "id"], F.struct("t", F.floor(F.col("id") / 10)), name="seq")
    assert _rows(got) == [(i, i + 1) for i in range(1000)]


def test_real_hits_by_minute_equal_the_plain_window(spark):
    h = testdata.raw_hits(spark, SF_SMALL)
    got = sequence_within(h, testdata.SEQUENCE_KEYS, testdata.SEQUENCE_ORDER, testdata.minute_of_day(), name="n")
    plain = h.withColumn("n", F.row_number().over(
        Window.partitionBy(*testdata.SEQUENCE_KEYS).orderBy(*testdata.SEQUENCE_ORDER)))
    assert got.columns == plain.columns
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_files_appended_between_two_calls_are_seen(spark, tmp_path):
    path = str(tmp_path / "hits")
    schema = "k string, t int, id long"
    spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 3)], schema).write.parquet(path)
    number = lambda: _rows(sequence_within(spark.read.parquet(path), ["k"], ["t", "id"], F.col("t"), name="seq"))
    assert number() == [(1, 1), (2, 2), (3, 1)]
    spark.range(10, 5010).select(F.lit("a").alias("k"), F.lit(1).alias("t"), "id").write.mode("append").parquet(path)
    assert number() == [(1, 1), (2, 2), (3, 1)] + [(i, i - 7) for i in range(10, 5010)]
