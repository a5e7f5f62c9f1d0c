"""End-to-end batch: raw sessions + hits -> processed tables -> extracts + findings.

Stage boundaries are written tables (not cached lineage): the processed tables
are written once and read back, so every later step starts from Parquet and a
lost executor never replays the raw-hit enrichment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning, reports
from ..session import Scratch, materialize
from ..sinks import publish, writers
from ..spec import DEFAULT_SPEC, FunnelSpec


@dataclass
class BatchOutputs:
    sessions: str
    purchases: str
    events: str
    quality: str
    findings: str
    extracts: dict[str, str] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)


def run_batch(spark: SparkSession, raw_sessions: DataFrame, raw_hits: DataFrame, out_dir: str,
              spec: FunnelSpec = DEFAULT_SPEC, extract_format: str = "csv",
              database: str | None = None, buckets: int = 0, copy_inputs: bool = False) -> BatchOutputs:
    """Writes the processed tables, the quality report, the findings and the extracts.

    The inputs are read by four outputs. ``copy_inputs`` writes them to the
    shared checkpoint folder first: worth it where they are the result of costly
    work, a waste where they are files already.
    """
    out = out_dir.rstrip("/")
    paths = BatchOutputs(sessions=f"{out}/processed/sessions", purchases=f"{out}/processed/purchases",
                         events=f"{out}/processed/events_clean", quality=f"{out}/quality",
                         findings=f"{out}/findings")
    with Scratch(spark) as scratch:
        if copy_inputs:
            raw_sessions = materialize(raw_sessions, "batch-raw-sessions", scratch)
            raw_hits = materialize(raw_hits, "batch-raw-hits", scratch)
        # 1. clean / transform (one shuffle on session_id for the flags)
        writers.write_sessions_layout(cleaning.clean_sessions(raw_sessions, raw_hits, spec), paths.sessions)
        writers.write_parquet(cleaning.purchase_lines(raw_hits, raw_sessions, spec), paths.purchases)
        writers.write_parquet(cleaning.event_log(raw_hits, raw_sessions, spec), paths.events)
        writers.write_json_document(cleaning.quality_report(raw_sessions, raw_hits), paths.quality)
    # 2. analysis over the written tables
    sessions = spark.read.parquet(paths.sessions)
    purchases = spark.read.parquet(paths.purchases)
    writers.write_json_document(reports.findings(sessions, spec), paths.findings)
    # all six or none: a failure leaves the version before (sinks.publish)
    done = publish.publish_extracts(spark, sessions, purchases, f"{out}/extracts", extract_format, spec)
    paths.extracts = {name: f"{out}/extracts/{path}" for name, path in done.tables.items()}
    # 3. optional catalog tables for SQL users (FROM sessions / FROM purchases)
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        paths.tables = writers.save_relational_tables(sessions, purchases, database, buckets, spec)
    return paths
