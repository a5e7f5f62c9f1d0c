"""M28, M17, K5 by day: one changed day costs one day."""

from pathlib import Path

from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry.operators import daily_state, reports
from funnelry.plans import catalog
from funnelry.sinks import writers


def _files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def _same(a, b):
    return a.select(*b.columns).exceptAll(b).count() == 0 and a.count() == b.count()


def test_a_changed_day_rewrites_its_partition_and_gives_the_tables_of_a_full_run(spark, tmp_path):
    root = str(tmp_path / "state")
    s, p = catalog._sessions(spark, SF_SMALL), catalog._purchases(spark, SF_SMALL)
    daily_state.write_state(s, p, root)
    before = _files(root)
    day = s.agg(F.min("date")).first()[0]
    text = day.strftime("%Y%m%d")
    s2 = s.withColumn("purchased", F.when(F.col("date") == day, True).otherwise(F.col("purchased"))) \
        .withColumn("device", F.when(F.col("date") == day, "watch").otherwise(F.col("device")))
    p2 = p.where(F.col("date") != day)                      # the day has no purchase any more
    daily_state.write_state(s2, p2, root, days=[text])
    after = _files(root)
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if f"day={text}" in f}
    assert all(f"day={text}" in f for f in set(after) - set(before))
    got = daily_state.extracts_from_state(spark, root)
    want = writers.dashboard_tables(reports.metric_cube(s2), p2)
    assert set(got) == set(writers.EXTRACTS)
    for name in writers.EXTRACTS:
        assert _same(got[name], want[name]), name


def test_null_days_ranges_and_empty_input(spark, tmp_path):
    root = str(tmp_path / "state")
    s, p = catalog._sessions(spark, SF_SMALL), catalog._purchases(spark, SF_SMALL)
    odd = s.withColumn("date", F.when(F.col("device") == "tablet", None).otherwise(F.col("date")))
    daily_state.write_state(odd, p, root)
    assert _same(daily_state.merged_cube(daily_state.read_state(spark, root)[0]), reports.metric_cube(odd))
    days = sorted(r.date for r in s.select("date").distinct().collect())[:3]
    state, _ = daily_state.read_state(spark, root, *(d.strftime("%Y%m%d") for d in (days[0], days[-1])))
    assert {r.date for r in state.select("date").distinct().collect()} == set(days)
    daily_state.write_state(s.limit(0), p.limit(0), str(tmp_path / "none"), days=["20240101"])
    got = daily_state.extracts_from_state(spark, str(tmp_path / "none"))
    want = writers.dashboard_tables(reports.metric_cube(s.limit(0)), p.limit(0))
    assert all(got[n].count() == want[n].count() for n in writers.EXTRACTS)
