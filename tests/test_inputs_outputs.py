"""Readers that lose nothing, sorted layouts, joins that can be split, folders."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry import session
from funnelry.__main__ import main
from funnelry.operators import cleaning, funnel
from funnelry.plans.pipeline import run_batch
from funnelry.sinks import writers
from funnelry.sources import files, testdata
from funnelry.streaming import live_funnel

HITS = "hitNumber,session_id,hit_type,v2ProductCategory,productSKU,eCommerceAction_action_type,productPrice,extra\n"
SESSIONS = ("session_id,fullVisitorId,visitId,date,channelGrouping,deviceCategory,country,totals_pageviews,totals_bounces,"
            "totals_hits,totals_transactions,totals_transactionRevenue\n")


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = _file(tmp_path, "hits.csv", HITS + "1,s1,EVENT,Bags,A,6,2.5,zzz\n2,s1,EVENT,,,2,,\n")
    got = files.read_raw_hits(spark, path)
    assert got.columns == ["session_id", "hitNumber", "hit_type", "eCommerceAction_action_type", "productSKU",
                           "v2ProductCategory", "productPrice"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("s1", 1, "EVENT", 6, "A", "Bags", 2.5), ("s1", 2, "EVENT", 2, None, None, None)], key=str)


def test_csv_whole_numbers_may_be_written_as_floats(spark, tmp_path):
    path = _file(tmp_path, "s.csv", SESSIONS + "s1,v1,1.0,20240101,Direct,desktop,US,3.0,0,4,1.0,5000000.0\n"
                                               "s2,v2,9007199254740993,20240101,Direct,desktop,US,,,4,,\n")
    rows = {r.session_id: r for r in files.read_raw_sessions(spark, path).collect()}
    assert (rows["s1"].visitId, rows["s1"].totals_transactions, rows["s1"].totals_transactionRevenue) == (1, 1, 5000000)
    assert rows["s2"].visitId == 9007199254740993 and rows["s2"].totals_transactions is None


@pytest.mark.parametrize("line", ["s1,v1,1,20240101,Direct,desktop,US,many,0,4,1,5", "s1,v1,1,20240101,Direct,desktop,US,1.5,0,4,1,5"])
def test_csv_bad_cells_fail_or_are_null_on_request(spark, tmp_path, line):
    path = _file(tmp_path, "s.csv", SESSIONS + line + "\n")
    with pytest.raises(PySparkException, match="totals_pageviews"):
        files.read_raw_sessions(spark, path).collect()
    assert files.read_raw_sessions(spark, path, strict=False).first().totals_pageviews is None


def test_csv_missing_column_and_differing_headers_fail(spark, tmp_path):
    path = _file(tmp_path, "h.csv", "session_id,hitNumber\ns1,1\n")
    with pytest.raises(files.BadInput, match="productSKU"):
        files.read_raw_hits(spark, path)
    both = tmp_path / "both"
    both.mkdir()
    _file(both, "a.csv", "productSKU,v2ProductCategory,productPrice\nA,Bags,1\n")
    _file(both, "b.csv", "v2ProductCategory,productSKU,productPrice\nBags,B,1\n")
    with pytest.raises(Exception, match="does not conform"):
        files.read_products(spark, str(both)).collect()


def test_bad_dates_are_null_in_clean_sessions_and_stay_rows(spark, tmp_path):
    path = _file(tmp_path, "s.csv", SESSIONS + "s1,v1,1,20240101,Direct,desktop,US,1,0,4,1,5\ns2,v1,1,,Direct,desktop,US,1,0,4,1,5\n")
    clean = cleaning.clean_sessions(files.read_raw_sessions(spark, path), testdata.raw_hits(spark, SF_SMALL))
    assert sorted((r.session_id, r.date is None) for r in clean.collect()) == [("s1", False), ("s2", True)]


def test_session_layout_is_sorted_in_its_files(spark, tmp_path):
    path = str(tmp_path / "layout")
    rows = [(f"s{i}", "mdt"[i % 3], "zyx"[i % 3 - i % 2]) for i in range(300)]
    s = spark.createDataFrame(rows, "session_id string, device string, channel string").withColumn("date", F.lit("2024-01-01"))
    writers.write_sessions_layout(s, path)
    import pyarrow.parquet as pq
    found = sorted((tmp_path / "layout").rglob("*.parquet"))
    assert found
    for f in found:
        own = [(r["device"], r["channel"]) for r in pq.ParquetFile(f).read().to_pylist()]
        assert own == sorted(own)


def test_hot_sku_join_is_split_and_missing_skus_spread(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sku = F.when(F.col("id") % 5 < 4, F.lit("hot")).otherwise((F.col("id") % 300).cast("string"))
        hits = spark.range(0, 30000, 1, 8).select(F.col("id").cast("string").alias("session_id"), sku.alias("productSKU"))
        products = spark.range(300).select(F.col("id").cast("string").alias("productSKU"), F.lit("c").alias("v2ProductCategory"),
                                           F.lit(1.0).alias("productPrice"))
        j = cleaning.attach_products(hits, products)
        assert len(j.collect()) == 30000
        assert "SortMergeJoin(skew=true)" in j._jdf.queryExecution().executedPlan().toString()
        none = cleaning.attach_products(hits.withColumn("productSKU", F.lit(None).cast("string")), products)
        sizes = [r["count"] for r in none.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 30000 and max(sizes) < 3 * 30000 / len(sizes)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_repeated_sku_gives_one_whole_row(spark):
    hits = spark.createDataFrame([("s", "A"), ("s", None), ("s", "B")], "session_id string, productSKU string")
    products = spark.createDataFrame([("A", "bags", 1.0), ("A", "apparel", 9.0)], "productSKU string, v2ProductCategory string, productPrice double")
    got = cleaning.attach_products(hits, products)
    assert got.columns == ["session_id", "productSKU", "v2ProductCategory", "productPrice"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("s", "A", "bags", 1.0), ("s", None, None, 0.0), ("s", "B", None, 0.0)], key=str)


def test_batch_copies_inputs_only_on_request(spark, tmp_path, monkeypatch):
    written = []
    real = session.materialize
    monkeypatch.setattr("funnelry.plans.pipeline.materialize", lambda df, name, scratch=None: written.append(name) or real(df, name, scratch))
    m = testdata.load(spark, SF_SMALL)
    run_batch(spark, m.raw_sessions(), m.hits(), str(tmp_path / "a"))
    assert written == []
    run_batch(spark, m.raw_sessions(), m.hits(), str(tmp_path / "b"), copy_inputs=True)
    assert written == ["batch-raw-sessions", "batch-raw-hits"]
    rows = lambda d: sorted(map(str, spark.read.parquet(str(tmp_path / d / "processed/sessions")).collect()))
    assert rows("a") == rows("b")


def test_command_line_date_range_holds_for_hits(spark, tmp_path):
    sessions = _file(tmp_path, "s.csv", SESSIONS + "s1,v1,1,20240101,Direct,desktop,US,1,0,4,1,5\ns2,v1,2,20240301,Direct,desktop,US,1,0,4,1,5\n")
    hits = _file(tmp_path, "h.csv", HITS + "1,s1,EVENT,Bags,A,6,2.5,z\n1,s2,EVENT,Caps,B,6,9.5,z\n")
    out = main(["--sessions", sessions, "--hits", hits, "--out", str(tmp_path / "out"), "--date-from", "20240101", "--date-to", "20240131"])
    assert [r.session_id for r in spark.read.parquet(out["purchases"]).collect()] == ["s1"]
    assert [r.session_id for r in spark.read.parquet(out["events"]).collect()] == ["s1"]


def test_no_local_folder_off_a_local_master():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_the_applications_checkpoint_folder_stays(spark, tmp_path):
    jsc = spark.sparkContext._jsc.sc()
    before = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        own = jsc.getCheckpointDir().get()
        session.ensure_checkpoint_dir(spark)
        assert jsc.getCheckpointDir().get() == own and str(tmp_path) in own
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)


def test_streams_need_a_lasting_location_and_a_named_sink():
    with pytest.raises(TypeError):
        live_funnel.start(None, "name")


def test_sessions_count_ids(spark):
    s = spark.createDataFrame([("a", "d", True), (None, "d", True)], "session_id string, device string, purchased boolean")
    for c in ("reached_product_view", "reached_cart", "reached_checkout"):
        s = s.withColumn(c, F.lit(True))
    assert funnel.stage_counts(s).first().c0 == 1
    assert funnel.step_ratios(funnel.funnel_stage(s, by=["device"]), ["device"], "sessions").count() == 5
    with pytest.raises(ValueError):
        funnel.step_ratios(funnel.funnel_stage(s), [], "sessions")
