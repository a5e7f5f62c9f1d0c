"""The driver contract, exercised the way a harness might: a fresh process, a
bare session, the entry file loaded by path from another directory."""

import json
import subprocess
import sys
import tempfile
from pathlib import Path

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"

SCRIPT = f"""
import importlib.util, json
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_under_test", {str(ENTRY)!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = m.entry(spark)
from funnelry.plans.catalog import REGISTRY
out = {{"entry_rows": df.count(), "entry_cols": df.columns,
       "n_queries": len(REGISTRY), "n_oracle": len(REGISTRY.keys() & m.oracle_sql().keys()),
       "all_listed": REGISTRY.keys() <= m.queries().keys() and m.oracle_sql().keys() <= m.queries().keys()}}
for name in ["hit_sequence", "nested_funnel", "findings", "metric_cube"]:
    q = m.queries()[name](spark, "/root/testdata/sf0.001")
    out[name] = [q.count(), q.schema.simpleString() == m.queries()[name](spark, "/root/testdata/sf0.001").schema.simpleString()]
from funnelry.operators.sequence import sequence_within   # importable: the entry put its folder on sys.path
print("RESULT " + json.dumps(out))
"""


def test_entry_loaded_by_path_in_fresh_process():
    cwd = tempfile.mkdtemp(prefix="entry-cwd-")
    proc = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=600)
    line = [x for x in proc.stdout.splitlines() if x.startswith("RESULT ")]
    assert line, proc.stderr[-2000:]
    out = json.loads(line[0][len("RESULT "):])
    assert out["entry_rows"] == 5
    assert out["entry_cols"] == ["stage", "stage_order", "count", "pct_of_sessions", "step_conv"]
    assert out["n_queries"] == out["n_oracle"] + 1 and out["all_listed"]
    assert out["hit_sequence"] == [1000, True] and out["nested_funnel"] == [1, True]
    assert out["findings"] == [1, True] and out["metric_cube"][1] is True
