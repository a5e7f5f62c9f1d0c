"""The event log and the duplicate report as streams: a replay equals the batch result."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry.operators import cleaning
from funnelry.sources import testdata
from funnelry.streaming import event_stream as es
from funnelry.streaming import live_funnel as lf

COLUMNS = ["session_id", "hitNumber", "event_type", es.CODE, "productSKU", "v2ProductCategory", "channel", "device", "event_date"]


def _replay(spark, rows, path, order, parts):
    """The rows as a stream of files, in the order of a column, a file a batch."""
    ranked = rows.withColumn("_part", F.ntile(parts).over(Window.orderBy(order)))
    for i in range(1, parts + 1):
        ranked.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _inputs(spark):
    m = testdata.load(spark, SF_SMALL)
    hits = m.hits().withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = cleaning._session_dims(m.raw_sessions()).withColumn("session_ts", F.col("date").cast("timestamp"))
    return hits, sessions


def test_event_log_replayed_equals_batch_with_bounded_state(spark, tmp_path):
    hits, sessions = _inputs(spark)
    lost = hits.where(F.col(es.CODE) == 6).orderBy("event_id").first().session_id
    sessions = sessions.where(F.col("session_id") != lost)          # a session that never comes: its hits get NULLs
    want = cleaning.event_log(hits, sessions).select(*COLUMNS)
    assert es.event_log_stream(hits, sessions).select(*COLUMNS).exceptAll(want).count() == 0
    # rows far ahead push the watermark past all others at the end
    end_hit = hits.limit(1).withColumns({"session_id": F.lit("end"), "ts": F.lit("2100-01-01").cast("timestamp"), es.CODE: F.lit(2)})
    end = sessions.limit(1).withColumns({"session_id": F.lit("end2"), "session_ts": F.lit("2100-01-01").cast("timestamp")})
    stream = es.event_log_stream(_replay(spark, hits.unionByName(end_hit), f"{tmp_path}/h", "ts", 12),
                                 _replay(spark, sessions.unionByName(end), f"{tmp_path}/s", "session_ts", 12))
    q = lf.start(stream, "event_log_replay", f"{tmp_path}/ckpt", "memory")
    q.awaitTermination()
    got = spark.table("event_log_replay").where("session_id <> 'end'").select(*COLUMNS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where(F.col("session_id") == lost).where("channel IS NULL AND device IS NULL").count() > 0
    seen = es.stream_counts(q)
    mapped = hits.where(F.col(es.CODE).isin(2, 3, 5, 6)).count()
    assert seen.most_state_rows < 0.6 * (mapped + sessions.count()) and seen.state_rows <= 4 and seen.late_rows == 0


def test_repeats_within_the_watermark_go_and_are_counted(spark, tmp_path):
    hits, _ = _inputs(spark)
    again = hits.where(F.col("event_id") % 3 == 0)
    late = hits.orderBy("ts").limit(5).withColumn("event_id", F.col("event_id") + 10 ** 9)
    stream = _replay(spark, hits.unionByName(again), f"{tmp_path}/h", "ts", 6)
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")  # the oldest hits once more under new ids, after all others
    q = lf.start(es.unique_hits(stream), "unique_replay", f"{tmp_path}/ckpt", "memory")
    q.awaitTermination()
    report = cleaning.duplicate_keys(hits.unionByName(again), "event_id").first()
    counts = es.stream_counts(q)
    assert spark.table("unique_replay").count() == report.distinct_keys == hits.count()
    assert (counts.rows, counts.duplicate_rows, counts.late_rows) == (report["rows"] + 5, report.duplicate_rows, 5)
    assert counts.most_state_rows < 0.6 * report.distinct_keys
    assert es.unique_hits(hits.unionByName(again)).count() == report.distinct_keys
