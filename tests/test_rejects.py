"""Cells that do not fit are rejects, never the end of a job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelry.functions.columns import parse_yyyymmdd
from funnelry.operators import cleaning
from funnelry.sources import files, rejects

HEADER = "session_id,fullVisitorId,visitId,date,channelGrouping,deviceCategory,country,totals_pageviews,totals_bounces,totals_hits," \
         "totals_transactions,totals_transactionRevenue\n"
LINES = ["s1,v1,1,20160229,Direct,desktop,US,1,0,4,1,5000000", "s2,v2,2,20160230,Direct,desktop,US,1,0,4,,",
         "s3,v3,3,2016-01-01,Direct,desktop,US,many,0,4,1,5", "s4,v4,4,,Direct,desktop,US,2.0,0,4,1,5", ",v5,5,20160101,,,,1,0,4,1,5",
         "s6,v6,6", "s7,v7,99999999999999999999,abcdefgh,,,,1,0,4,1,5"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_rows_are_split_in_one_pass(spark, tmp_path, ansi):
    (tmp_path / "s.csv").write_text(HEADER + "\n".join(LINES) + "\n")
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = rejects.read_checked(spark, str(tmp_path / "s.csv"), out=str(tmp_path / "out"))
        good = {r.session_id: (r.date, r.totals_pageviews, r.totals_transactionRevenue) for r in got.good.collect()}
        assert good == {"s1": ("20160229", 1, 5000000), "s4": (None, 2, 5)}
        assert [f.dataType for f in got.good.schema] == [f.dataType for f in files.S.RAW_SESSIONS]
        bad = sorted((r.session_id, r["column"], r.value, r.reason) for r in got.rejects.fillna("", ["session_id"]).collect()
                     if r["column"] != "_line")
        assert bad == sorted([
            ("s2", "date", "20160230", "not a date yyyyMMdd"), ("s3", "date", "2016-01-01", "not a date yyyyMMdd"),
            ("s3", "totals_pageviews", "many", "not a int"), ("", "session_id", None, "missing"),
            ("s7", "date", "abcdefgh", "not a date yyyyMMdd"), ("s7", "visitId", "99999999999999999999", "not a bigint")], key=str)
        lines = got.rejects.where("column = '_line'").collect()
        assert [r.value for r in lines] == ["s6,v6,6"]
        counts = {(r["column"], r.reason): r["rows"] for r in rejects.reject_counts(got.rejects).collect()}
        assert counts[("date", "not a date yyyyMMdd")] == 3
        rejects.write_rejects(got.rejects, str(tmp_path / "rejects"))
        assert spark.read.option("header", True).csv(str(tmp_path / "rejects")).count() == got.rejects.count()
        # the written table is both: nothing is read from the input again
        (tmp_path / "s.csv").write_text("gone")
        assert got.good.count() == 2 and got.rejects.count() == 7
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_missing_column_is_an_error_and_empty_input_gives_empty_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("session_id,date\ns1,20160101\n")
    with pytest.raises(files.BadInput, match="visitId"):
        rejects.read_checked(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text(HEADER)
    got = rejects.read_checked(spark, str(tmp_path / "b.csv"))
    assert got.good.count() == 0 and got.rejects.count() == 0


def test_tolerant_dates_parse_only_what_is_a_date(spark):
    texts = ["20160229", "20160230", "20161301", "2016022", "201602290", " 20160229", "2016-2-9", "abcd0101", "00000000", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in frame.select(parse_yyyymmdd("t", tolerant=True).alias("d")).collect()]
    assert got == [dt.date(2016, 2, 29)] + [None] * 10
    with pytest.raises(Exception, match="parsed|CANNOT_PARSE|CAST_INVALID"):
        frame.select(parse_yyyymmdd("t")).collect()


def test_operators_take_sessions_with_tolerant_dates(spark):
    raw = spark.createDataFrame([("s1", "v", 1, "20160230", "Direct", "desktop", "US", 1, 0, 2, 1, 5000000),
                                 ("s2", "v", 1, None, "Direct", "desktop", "US", 1, 0, 2, 0, None),
                                 ("s2", "v", 2, "20160101", "Direct", "desktop", "US", 1, 0, 2, 0, None)], _raw_schema())
    hits = spark.createDataFrame([("s1", 6, "A")], "session_id string, eCommerceAction_action_type int, productSKU string") \
        .withColumns({"v2ProductCategory": F.lit("x"), "productPrice": F.lit(1.0)})
    kept = cleaning.tolerant_dates(raw)
    assert cleaning.tolerant_dates(kept) is kept
    clean = cleaning.clean_sessions(kept, hits)
    assert sorted((r.session_id, str(r.date)) for r in clean.collect()) == [("s1", "None"), ("s2", "2016-01-01"), ("s2", "None")]
    assert cleaning.purchase_lines(hits, kept).first().date is None
    assert cleaning.event_log(hits, kept).first().event_date is None
    report = cleaning.quality_report(raw, hits, date="date").first()
    assert (report.sessions, report.duplicate_session_ids, report.sessions_without_hits, report.bad_dates, report.missing_dates) == (3, 1, 2, 1, 1)
    empty = cleaning.quality_report(raw.limit(0), hits.limit(0), date="date").first()
    assert (empty.bad_dates, empty.missing_dates) == (0, 0)


def _raw_schema():
    return "session_id string, fullVisitorId string, visitId long, date string, channelGrouping string, deviceCategory string, " \
           "country string, totals_pageviews int, totals_bounces int, totals_hits int, totals_transactions int, totals_transactionRevenue long"
