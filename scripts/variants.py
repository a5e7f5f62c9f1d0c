"""

Usage: python scripts/variants.py [sf_dir] [cpus]
Prints one JSON line: seconds (best of 3 warm runs) per variant.
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def best(fn, runs=3):
    out = None
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        dt = time.perf_counter() - t0
        out = dt if out is None else min(out, dt)
    return round(out, 4)


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    from funnelry.session import get_spark
    from funnelry.operators import cleaning, funnel, nested, reports
    from funnelry.operators.sequence import sequence_within
    from funnelry.sources import testdata

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)
    m = testdata.load(spark, sf)
    s = m.sessions()
    noop(s)  # warm-up
    res = {}
    res["cube_grouping_sets"] = best(lambda: noop(reports.metric_cube(s)))
    res["cube_five_queries"] = best(lambda: [noop(x) for x in (
        reports.totals(s), funnel.funnel_by_segment(s, "device"), funnel.channel_performance(s),
        funnel.segment_matrix(s), funnel.daily_trend(s))])

    h = testdata.raw_hits(spark, sf)
    res["flags_bool_or"] = best(lambda: noop(cleaning.stage_flags(h)))
    code = F.col(cleaning.CODE)
    sets = h.where(code.isin(2, 3, 5)).groupBy("session_id").agg(F.collect_set(code).alias("s"))
    res["flags_collect_set"] = best(lambda: noop(sets.select(
        "session_id", *[F.array_contains("s", c).alias(f"f{c}") for c in (2, 3, 5)])))

    nest = nested.to_nested_sessions(m.raw_sessions(), m.hits(columns=["session_id", cleaning.CODE, "ts", "event_id"]),
                                     bucket=F.hour("ts"), order=testdata.SEQUENCE_ORDER)
    from funnelry.session import Scratch, materialize
    with Scratch(spark) as scratch:                 # the nested copy is released afterwards
        n = materialize(nest, "variants-nested", scratch)
        res["nested_exists"] = best(lambda: noop(n.select("fullVisitorId", "visitId", *nested.exists_flags(n))))
        ex = n.select("fullVisitorId", "visitId", F.explode_outer("hits").alias("h"))
        res["nested_explode_groupby"] = best(lambda: noop(ex.groupBy("fullVisitorId", "visitId").agg(
            *[F.coalesce(F.max(F.col("h.eCommerceAction.action_type") == str(c)), F.lit(False)).alias(f"f{c}")
              for c in (2, 3, 5)])))

    seq_in = h.select("session_id", "user_id", "event_day", "ts", "event_id")
    res["sequence_by_bucket"] = best(lambda: noop(sequence_within(
        seq_in, testdata.SEQUENCE_KEYS, testdata.SEQUENCE_ORDER, testdata.minute_of_day(), name="n")))
    w = Window.partitionBy("user_id", "event_day").orderBy("ts", "event_id")
    res["sequence_window"] = best(lambda: noop(seq_in.withColumn("n", F.row_number().over(w))))
    print(json.dumps({"sf": Path(sf).name, "cpus": cpus, "spark": spark.version, "best_of": 3, "sec": res}))


if __name__ == "__main__":
    main()
