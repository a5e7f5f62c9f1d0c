"""A table a day, picked by its name before anything is read."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry.operators import nested
from funnelry.plans import catalog
from funnelry.sinks import writers
from funnelry.sources import day_tables, files

RECORD = "fullVisitorId string, visitId {id}, date string, channelGrouping string, device struct<deviceCategory:string>, " \
         "geoNetwork struct<country:string{geo}>, totals struct<pageviews:int,transactions:int,transactionRevenue:long>, " \
         "hits array<struct<hitNumber:int,eCommerceAction:struct<action_type:string>{hit}>>{more}"


def _day(spark, root, day, rows=1, kind="long", geo="", hit="", more="", date=True, prefix="ga_sessions_"):
    """A day's table of records; ``geo``, ``hit`` and ``more`` are further fields."""
    extra = tuple(["x"] if more else [])
    value = [(f"v{i}", str(i) if kind == "string" else i, day if date else None, "Direct", ("desktop",),
              ("US", "CA") if geo else ("US",), (1, 1, 5), [(1, ("2",), 7) if hit else (1, ("2",))], *extra) for i in range(rows)]
    schema = RECORD.format(id=kind, geo=geo, hit=hit, more=more)
    frame = spark.createDataFrame(value, schema)
    (frame if date else frame.drop("date")).write.parquet(f"{root}/{prefix}{day}")


def test_a_range_opens_its_own_days_only(spark, tmp_path):
    root = str(tmp_path)
    for d in range(1, 31):
        _day(spark, root, f"201611{d:02d}", rows=d)
    (tmp_path / "ga_sessions_intraday_20161108").mkdir()
    (tmp_path / "ga_sessions_20161399").mkdir()
    (tmp_path / "ga_sessions_20161108.txt").write_text("no table")
    days = day_tables.list_day_tables(spark, root, "20161105", "20161111")
    assert [t.day for t in days] == [f"201611{d:02d}" for d in range(5, 12)]
    df = day_tables.read_day_tables(spark, root, "20161105", "20161111")
    read = {f.split("/")[-2] for f in df.inputFiles()}
    assert read == {f"ga_sessions_201611{d:02d}" for d in range(5, 12)}
    assert {r.table_suffix: r["count"] for r in df.groupBy("table_suffix").count().collect()} == {
        f"201611{d:02d}": d for d in range(5, 12)}
    # the files of other days may even be broken
    (tmp_path / "ga_sessions_20161101" / "part-x.parquet").write_text("broken")
    assert day_tables.read_day_tables(spark, root, "20161105", "20161111").count() == sum(range(5, 12))
    assert len(day_tables.list_day_tables(spark, root)) == 30


def test_days_whose_fields_differ_are_united(spark, tmp_path):
    root = str(tmp_path)
    _day(spark, root, "20161101")
    _day(spark, root, "20161102", kind="string", geo=",region:string", hit=",page:int", more=", medium string")
    _day(spark, root, "20161103", date=False)
    plain = day_tables.read_day_tables(spark, root)
    assert plain.columns == [*[f.name for f in files.S.NESTED_SESSIONS.fields], "table_suffix"]
    assert sorted((r.date, r.table_suffix, r.visitId, r.hits[0].eCommerceAction.action_type) for r in plain.collect()) == [
        (d, d, 0, "2") for d in ("20161101", "20161102", "20161103")]
    more = day_tables.read_day_tables(spark, root, extra_fields=True)
    got = {r.table_suffix: (r.medium, r.geoNetwork.region, r.geoNetwork.country, r.hits[0].page) for r in more.collect()}
    assert got == {"20161101": (None, None, "US", None), "20161102": ("x", "CA", "US", 7), "20161103": (None, None, "US", None)}
    # days with one schema are one scan, and fields that are not wanted are not read
    scans = plain._jdf.queryExecution().executedPlan().toString()
    assert scans.count("FileScan parquet") == 3 and "region" not in scans and "Exchange" not in nested.flatten_nested(
        plain)._jdf.queryExecution().executedPlan().toString()


def test_further_fields_that_do_not_fit_together_are_an_error(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("v", 1)], "fullVisitorId string, score int").write.parquet(f"{root}/ga_sessions_20161101")
    spark.createDataFrame([("v", 2)], "fullVisitorId string, score long").write.parquet(f"{root}/ga_sessions_20161102")
    wide = day_tables.read_day_tables(spark, root, extra_fields=True)
    assert dict(wide.dtypes)["score"] == "bigint" and sorted(r.score for r in wide.collect()) == [1, 2]
    spark.createDataFrame([("v", "a")], "fullVisitorId string, score string").write.parquet(f"{root}/ga_sessions_20161103")
    with pytest.raises(files.BadInput, match="score"):
        day_tables.read_day_tables(spark, root, extra_fields=True)


def test_no_tables_missing_days_and_empty_ranges(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(files.BadInput, match="no table"):
        day_tables.read_day_tables(spark, root)
    _day(spark, root, "20161101")
    _day(spark, root, "20161103")
    none = day_tables.read_day_tables(spark, root, "20170101", "20170131")
    assert none.count() == 0 and "table_suffix" in none.columns
    with pytest.raises(files.BadInput, match="20161102"):
        day_tables.read_day_tables(spark, root, "20161101", "20161103", all_days=True)
    assert day_tables.read_day_tables(spark, root, "20161103", all_days=True).count() == 1


def test_json_days(spark, tmp_path):
    for day, more in (("20161101", {}), ("20161102", {"medium": "x"})):
        (tmp_path / f"ga_sessions_{day}").mkdir()
        (tmp_path / f"ga_sessions_{day}" / "a.json").write_text(json.dumps(
            {"fullVisitorId": "v", "visitId": 1, "hits": [{"hitNumber": 1, "eCommerceAction": {"action_type": "3"}}], **more}))
    got = day_tables.read_day_tables(spark, str(tmp_path), fmt="json")
    assert sorted(r.date for r in got.collect()) == ["20161101", "20161102"] and "medium" not in got.columns
    wide = day_tables.read_day_tables(spark, str(tmp_path), fmt="json", extra_fields=True)
    assert sorted(str(r.medium) for r in wide.collect()) == ["None", "x"]


def test_written_day_tables_replace_their_days_only(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "20240101"), ("b", "20240102"), ("c", "20240102")], "fullVisitorId string, date string")
    assert writers.write_day_tables(rows, root) == ["20240101", "20240102"]
    assert writers.write_day_tables(rows.where("date = '20240102'").limit(1), root) == ["20240102"]
    assert {r.date: r["count"] for r in day_tables.read_day_tables(spark, root).groupBy("date").count().collect()} == {
        "20240101": 1, "20240102": 1}
    with pytest.raises(Exception, match="not a day"):
        writers.write_day_tables(rows.withColumn("date", F.lit("2024-01-01")), root)
    assert day_tables.read_day_tables(spark, root).count() == 2


def test_plain_exports_are_flattened_without_a_shuffle(spark, tmp_path):
    m = catalog._model(spark, SF_SMALL)
    whole = nested.to_nested_sessions(m.raw_sessions(), m.hits(columns=["session_id", "eCommerceAction_action_type", "ts", "event_id"]),
                                      bucket=F.lit(0), order=("ts", "event_id"))
    path = str(tmp_path / "plain")
    whole.drop("record_id", "hit_fragment").write.parquet(path)
    flat = nested.flatten_nested(files.read_nested_sessions(spark, path))
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "uuid" not in plan and "Union" not in plan
    assert flat.exceptAll(m.sessions().select(*flat.columns)).count() == 0 and flat.count() == m.sessions().count()


def test_fragments_and_plain_records_in_one_table(spark):
    kind = files.NESTED_WITH_FRAGMENT
    rec = lambda v, code, rid: (v, 1, "20240101", "Direct", ("desktop",), ("US",), (1, 0, None), [(1, (code,))], 0, rid)
    df = spark.createDataFrame([rec("a", "2", "r1"), rec("a", "3", "r1"), rec("a", "5", None), rec("a", "5", None)], kind)
    got = sorted((r.reached_product_view, r.reached_cart, r.reached_checkout) for r in nested.flatten_nested(df).collect())
    assert got == [(False, False, True), (False, False, True), (True, True, False)]
