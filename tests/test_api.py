from pyspark.sql import functions as F
import glob
import json
import tempfile

import pytest

from conftest import SF_SMALL
from fixtures import frames
from funnelry import __main__ as cli
from funnelry.api import FunnelAnalysis
from funnelry.operators import nested
from funnelry.sources import testdata


def test_facade_over_flat_input(spark):
    s, h, p = frames(spark)
    fa = FunnelAnalysis(s, h, p)
    assert [r["count"] for r in fa.funnel().orderBy("stage_order").collect()] == [6, 3, 3, 2, 2]
    assert fa.biggest_leak().first().stage == "Product View"
    assert fa.ztest().first().z == pytest.approx(-0.372678, abs=1e-6)
    assert fa.quality().first().sessions_without_hits == 1
    assert {r.category for r in fa.categories().collect()} == {"Apparel", None}
    assert fa.kpis().first().total_orders == 2 and fa.cube().count() == 16


def test_facade_over_nested_input(spark):
    m = testdata.load(spark, SF_SMALL)
    n = nested.to_nested_sessions(m.raw_sessions(), m.hits(), bucket=F.hour("ts"), order=testdata.SEQUENCE_ORDER)
    fa = FunnelAnalysis.from_nested(n)
    assert fa.totals().first().total_sessions == 397
    with pytest.raises(ValueError):
        fa.purchases()


def test_cli_flat_csv(spark, tmp_path):
    from test_pipeline import _write_csv
    from fixtures import HITS, SESSIONS
    _write_csv(tmp_path / "sessions.csv", ["fullVisitorId", "visitId", "session_id", "date", "channelGrouping",
                                           "deviceCategory", "country", "totals_pageviews", "totals_bounces",
                                           "totals_hits", "totals_transactions", "totals_transactionRevenue"],
               SESSIONS)
    _write_csv(tmp_path / "hits.csv", ["session_id", "hitNumber", "hit_type", "eCommerceAction_action_type",
                                       "productSKU", "v2ProductCategory", "productPrice"], HITS)
    out = tempfile.mkdtemp(prefix="cli-")
    res = cli.main(["--sessions", str(tmp_path / "sessions.csv"), "--hits", str(tmp_path / "hits.csv"),
                    "--out", out, "--database", "cli_db", "--buckets", "2"])
    assert spark.table(res["tables"]["sessions"]).count() == 6
    spark.sql("DROP DATABASE cli_db CASCADE")
    assert set(res["extracts"]) == {"funnel_stage", "funnel_by_device", "channel_performance",
                                    "device_channel_matrix", "daily_trend", "category_revenue"}
    doc = json.loads(open(glob.glob(f"{res['findings']}/part-*")[0]).read())
    assert doc["total_sessions"] == 6


def test_cli_nested(spark):
    m = testdata.load(spark, SF_SMALL)
    n = nested.to_nested_sessions(m.raw_sessions(), m.hits(), bucket=F.hour("ts"), order=testdata.SEQUENCE_ORDER)
    src = tempfile.mkdtemp(prefix="nested-src-") + "/ga"
    n.write.partitionBy("date").parquet(src)
    out = tempfile.mkdtemp(prefix="cli-nested-")
    res = cli.main(["--nested", src, "--date-from", "20240101", "--date-to", "20240110", "--out", out])
    assert spark.read.parquet(res["sessions"]).count() > 0 and "funnel_stage" in res["extracts"]


def test_materialized_sessions_serve_every_metric(spark):
    s, h, p = frames(spark)
    fa = FunnelAnalysis(s, h, p).materialize()
    plan = fa.funnel()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "funnel-sessions" in plan     # one scan: the written sessions
    assert [r["count"] for r in fa.funnel().orderBy("stage_order").collect()] == [6, 3, 3, 2, 2]
    assert fa.ztest().first().z == pytest.approx(-0.372678, abs=1e-6)


def test_cli_day_tables_and_tolerant_sessions(spark, tmp_path):
    from funnelry.sinks import writers
    m = testdata.load(spark, SF_SMALL)
    n = nested.to_nested_sessions(m.raw_sessions(), m.hits(), bucket=F.lit(0), order=testdata.SEQUENCE_ORDER)
    writers.write_day_tables(n.drop("record_id", "hit_fragment"), f"{tmp_path}/ga")
    res = cli.main(["--nested", f"{tmp_path}/ga", "--day-tables", "--tolerant", "--date-from", "20240103", "--date-to", "20240105",
                    "--out", f"{tmp_path}/out"])
    got = spark.read.parquet(res["sessions"])
    want = m.sessions().where(F.col("date").between("2024-01-03", "2024-01-05"))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count() > 0
    assert FunnelAnalysis.from_day_tables(spark, f"{tmp_path}/ga", "20240103", "20240105").sessions().count() == got.count()
    header = "fullVisitorId,visitId,session_id,date,channelGrouping,deviceCategory,country,totals_pageviews,totals_bounces," \
             "totals_hits,totals_transactions,totals_transactionRevenue\n"
    (tmp_path / "s.csv").write_text(header + "v,1,s1,20160102,Direct,desktop,US,1,0,2,1,5\nv,1,s2,20160231,Direct,desktop,US,x,0,2,1,5\n")
    (tmp_path / "h.csv").write_text("session_id,hitNumber,hit_type,eCommerceAction_action_type,productSKU,v2ProductCategory,productPrice\n"
                                    "s1,1,EVENT,6,A,Bags,1.5\n")
    res = cli.main(["--sessions", f"{tmp_path}/s.csv", "--hits", f"{tmp_path}/h.csv", "--tolerant", "--out", f"{tmp_path}/flat"])
    assert [r.session_id for r in spark.read.parquet(res["sessions"]).collect()] == ["s1"]
    rejected = spark.read.option("header", True).csv(f"{tmp_path}/flat/rejects").collect()
    assert sorted(r["column"] for r in rejected) == ["date", "totals_pageviews"] and {r.session_id for r in rejected} == {"s2"}
