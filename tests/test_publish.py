"""K3, K5: readers see one whole version, whatever happens to a publication."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelry.plans import catalog
from funnelry.sinks import publish, writers


def _tables(spark, n, fail_at=None):
    raised = F.raise_error(F.lit("lost")).cast("int")
    return {f"t{i}": spark.range(1).select((raised if i == fail_at else F.lit(n)).alias("version")) for i in range(6)}


def _seen(spark, root):
    now = publish.current_manifest(spark, root)
    return {publish.read_published(spark, root, t, now).first().version for t in now.tables}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failure_after_some_tables_leaves_the_old_six_together(spark, tmp_path, fmt):
    root = str(tmp_path / "out")
    with pytest.raises(publish.NothingPublished):
        publish.current_manifest(spark, root)
    assert publish.publish(spark, _tables(spark, 1), root, fmt).version == 1
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, _tables(spark, 2, fail_at=3), root, fmt)
    assert (tmp_path / "out" / "versions" / f"{2:012d}" / "t2").exists()      # half of it is there, and not seen
    assert publish.current_manifest(spark, root).version == 1 and _seen(spark, root) == {1}
    assert publish.publish(spark, _tables(spark, 3), root, fmt).version == 3
    assert _seen(spark, root) == {3}


def test_readers_of_the_version_before_can_finish(spark, tmp_path):
    root = str(tmp_path / "out")
    old = publish.publish(spark, _tables(spark, 1), root)
    publish.publish(spark, _tables(spark, 2), root)
    assert publish.read_published(spark, root, "t5", old).first().version == 1
    publish.publish(spark, _tables(spark, 3), root)
    assert sorted(p.name for p in (tmp_path / "out" / "versions").iterdir()) == [f"{n:012d}" for n in (2, 3)]
    with pytest.raises(ValueError):
        publish.publish(spark, _tables(spark, 4), root, keep=0)


def test_checks_before_the_switch_and_two_publications_at_once(spark, tmp_path):
    root = str(tmp_path / "out")
    publish.publish(spark, _tables(spark, 1), root)

    def refuse(manifest):
        assert publish.read_published(spark, root, "t0", manifest).first().version == 2
        raise AssertionError("too few rows")

    with pytest.raises(AssertionError, match="too few"):
        publish.publish(spark, _tables(spark, 2), root, before_switch=refuse)
    assert _seen(spark, root) == {1}

    def other_is_faster(manifest):
        publish._switch(publish._Folder(spark, root), manifest)

    with pytest.raises(publish.PublishConflict):
        publish.publish(spark, _tables(spark, 5), root, before_switch=other_is_faster)


def test_six_extracts(spark, tmp_path):
    root = str(tmp_path / "out")
    s, p = catalog._sessions(spark, SF_SMALL), catalog._purchases(spark, SF_SMALL)
    done = publish.publish_extracts(spark, s, p, root, "csv")
    assert set(done.tables) == set(writers.EXTRACTS)
    assert publish.read_published(spark, root, "funnel_stage").count() == 5


def test_catalog_views_move_when_all_tables_are_written(spark):
    made = publish.publish_catalog(spark, {"a": spark.range(3), "b": spark.range(4)}, "twophase", 1)
    assert spark.table("twophase.a").count() == 3 and made["b"] == "twophase.b__v1"
    bad = {"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("lost")).cast("int").alias("id"))}
    with pytest.raises(Exception, match="lost"):
        publish.publish_catalog(spark, bad, "twophase", 2)
    assert (spark.table("twophase.a").count(), spark.table("twophase.b").count()) == (3, 4)
    publish.publish_catalog(spark, {"a": spark.range(9), "b": spark.range(8)}, "twophase", 3)
    assert (spark.table("twophase.a").count(), spark.table("twophase.b").count()) == (9, 8)
