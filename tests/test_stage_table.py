"""Stages as data."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry.operators import cleaning, funnel, stage_table
from funnelry.plans import catalog
from funnelry.spec import DEFAULT_SPEC

STAGES = "code int, stage string, stage_order long"
HITS = "session_id string, eCommerceAction_action_type int"


def _funnel(spark, sessions, hits, stages, by=()):
    stages = spark.createDataFrame(stages, STAGES)
    masked = stage_table.with_masks(spark.createDataFrame(sessions, "session_id string, device string"),
                                    stage_table.stage_masks(spark.createDataFrame(hits, HITS), stages))
    return stage_table.stage_funnel(masked, stages, by=by)


def test_twelve_stages_without_a_spec(spark):
    stages = [(10 * i, f"step {i}", i) for i in range(1, 13)]
    sessions = [(f"s{i}", "m" if i % 2 else "d") for i in range(13)]
    hits = [(f"s{i}", 10 * j) for i in range(13) for j in range(1, i + 1)] * 3 + [("s1", 999), ("s1", None), ("nobody", 10)]
    got = _funnel(spark, sessions, hits, stages).orderBy("stage_order").collect()
    assert [(r.stage, r["count"]) for r in got] == [("Sessions", 13)] + [(f"step {i}", 13 - i) for i in range(1, 13)]
    assert got[0].step_conv is None and got[12].step_conv == 1 / 2 and got[12].pct_of_sessions == 1 / 13
    by = _funnel(spark, sessions, hits, stages, by=("device",))
    assert {(r.device, r.stage_order): r["count"] for r in by.collect()}[("d", 12)] == 1 and by.count() == 26


def test_default_stages_equal_the_spec(spark):
    got = catalog.REGISTRY["stage_table_funnel"](spark, SF_SMALL)
    want = catalog.REGISTRY["funnel_overall"](spark, SF_SMALL)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    m = catalog._model(spark, SF_SMALL)
    stages = spark.createDataFrame([(s.code, s.label, i) for i, s in enumerate(DEFAULT_SPEC.hit_stages, 1)], STAGES)
    masks = stage_table.stage_masks(m.hits(columns=["session_id", cleaning.CODE]), stages)
    flags = cleaning.stage_flags(m.hits(columns=["session_id", cleaning.CODE]))
    both = masks.join(flags, "session_id")
    assert both.count() == masks.count()
    for i, s in enumerate(DEFAULT_SPEC.hit_stages):
        assert both.where((F.col("mask").bitwiseAND(F.lit(1 << i)) != 0) != F.col(s.flag)).count() == 0
    segments = stage_table.stage_funnel(stage_table.with_masks(m.sessions().select("session_id", "device"), masks), stages, by=("device",))
    by = funnel.funnel_frame(m.sessions(), DEFAULT_SPEC, by=("device",)).where("stage <> 'Purchase'")
    assert segments.select(*by.columns).exceptAll(by).count() == 0


@pytest.mark.parametrize("stages, message", [
    ([(1, "a", 1), (1, "b", 2)], "the code 1"), ([(1, "a", 1), (2, "b", 1)], "the order 1"),
    ([(1, "a", 0)], "not 0"), ([(1, "a", 63)], "not 63"), ([(1, "a", None)], "not NULL")])
def test_guards_name_the_value(spark, stages, message):
    with pytest.raises(Exception, match=message):
        _funnel(spark, [("s", "d")], [("s", 1)], stages).collect()


def test_empty_sessions_and_stages(spark):
    got = _funnel(spark, [], [], [(1, "a", 1), (2, "b", 62)]).orderBy("stage_order").collect()
    assert [(r.stage, r["count"], r.pct_of_sessions, r.step_conv) for r in got] == [
        ("Sessions", 0, None, None), ("a", 0, None, None), ("b", 0, None, None)]
    assert [(r.stage, r["count"]) for r in _funnel(spark, [("s", None)], [("s", 1)], []).collect()] == [("Sessions", 1)]
    null = _funnel(spark, [("s", None)], [("s", 1)], [(1, "a", 1)], by=("device",)).collect()
    assert sorted((r.device, r.stage_order, r["count"]) for r in null) == [(None, 0, 1), (None, 1, 1)]


def test_masks_combine_before_the_shuffle(spark):
    hits = spark.range(1000).select(F.lit("bot").alias("session_id"), (F.col("id") % 3).cast("int").alias(cleaning.CODE))
    masks = stage_table.stage_masks(hits, spark.createDataFrame([(1, "a", 1), (2, "b", 2)], STAGES))
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "CartesianProduct" not in plan
    assert masks.first().mask == 3
