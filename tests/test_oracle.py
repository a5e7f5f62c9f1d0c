"""Every registered query against its DuckDB oracle (whole sf0.001 tables)."""

import sys
from pathlib import Path

import duckdb
import pytest

from conftest import SF_SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))
from check_oracle import TABLES, rows_of  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from funnelry.plans.catalog import REGISTRY  # noqa: E402

NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(SF_SMALL) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_oracle_or_is_documented():
    missing = set(REGISTRY) - set(entry.oracle_sql())
    assert missing == {"findings"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["stage", "stage_order", "count", "pct_of_sessions", "step_conv"]
    assert df.count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(rows) == 1
        return
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, rows) == rows_of(cols, cur.fetchall())


def test_quality_report_orders_finds_something_over_whole_tables(spark, duck):
    r = entry.queries()["quality_report_orders"](spark, SF_SMALL).first()
    count = lambda t: duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0]
    assert (r.sessions, r.hits) == (count("orders"), count("events"))
    assert r.duplicate_session_ids > 0 and r.sessions_without_hits > 0
