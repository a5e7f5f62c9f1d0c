"""Command line: run the batch funnel pipeline on raw session/hit files.

    python -m funnelry --sessions data/raw/sessions.csv --hits data/raw/hits.csv --out out/
    python -m funnelry --nested ga_sessions/ --date-from 20161101 --date-to 20170131 --out out/

Flat input: writes processed tables, the quality report, the findings
document and the six dashboard extracts (see ``plans.pipeline``). Nested
input: flattens the records (optionally a date range) and writes the clean
sessions, the findings document and the stage/device/channel/matrix/daily
extracts. A date range holds for the hits too: those of sessions outside it go.
"""

from __future__ import annotations

import argparse
import json

from .session import get_spark


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="funnelry")
    ap.add_argument("--sessions", help="raw flat sessions (csv or parquet)")
    ap.add_argument("--hits", help="raw flat hits (csv or parquet)")
    ap.add_argument("--nested", help="nested session records directory (parquet or json)")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet", "json"], help="input format")
    ap.add_argument("--day-tables", action="store_true", help="--nested holds a table a day, ga_sessions_yyyyMMdd")
    ap.add_argument("--tolerant", action="store_true", help="session rows with bad cells go to <out>/rejects and end no job (csv)")
    ap.add_argument("--date-from")
    ap.add_argument("--date-to")
    ap.add_argument("--out", required=True)
    ap.add_argument("--extract-format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--database", help="also save catalog tables <database>.sessions / .purchases")
    ap.add_argument("--buckets", type=int, default=0, help="bucket the catalog tables on session_id")
    ap.add_argument("--master", default=None, help="Spark master (default: the session's own)")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession
    spark = (get_spark(master=args.master) if args.master else SparkSession.builder.getOrCreate())
    from .operators import cleaning, funnel, nested, reports
    from .plans.pipeline import run_batch
    from .sinks import publish, writers
    from .sources import day_tables, files, rejects

    out = args.out.rstrip("/")
    if args.nested:
        fmt = "json" if args.format == "json" else "parquet"
        read = (lambda: day_tables.read_day_tables(spark, args.nested, args.date_from, args.date_to, fmt=fmt)) if args.day_tables \
            else (lambda: files.read_nested_sessions(spark, args.nested, fmt, args.date_from, args.date_to))
        n = cleaning.tolerant_dates(read()) if args.tolerant else read()
        writers.write_parquet(nested.flatten_nested(n), f"{out}/processed/sessions")
        s = spark.read.parquet(f"{out}/processed/sessions")
        writers.write_json_document(reports.findings(s), f"{out}/findings")
        tables = {"funnel_stage": funnel.funnel_stage(s), "funnel_by_device": funnel.funnel_by_segment(s),
                  "channel_performance": funnel.channel_performance(s),
                  "device_channel_matrix": funnel.segment_matrix(s), "daily_trend": funnel.daily_trend(s)}
        done = publish.publish(spark, tables, f"{out}/extracts", args.extract_format, single_file=writers.ONE_FILE)
        result = {"sessions": f"{out}/processed/sessions", "findings": f"{out}/findings",
                  "extracts": {name: f"{out}/extracts/{path}" for name, path in done.tables.items()}}
    else:
        if not (args.sessions and args.hits):
            ap.error("--sessions and --hits are required without --nested")
        fmt = "parquet" if args.format == "parquet" else "csv"
        if args.tolerant and fmt == "csv":
            parts = rejects.read_checked(spark, args.sessions, out=f"{out}/checked")
            rejects.write_rejects(parts.rejects, f"{out}/rejects")
            raw_s = parts.good
        else:
            raw_s = files.read_raw_sessions(spark, args.sessions, fmt)
        raw_s = files.date_range(raw_s, args.date_from, args.date_to)
        raw_h = files.read_raw_hits(spark, args.hits, fmt)
        if args.date_from or args.date_to:
            raw_h = raw_h.join(raw_s.select("session_id").distinct(), "session_id", "left_semi")
        paths = run_batch(spark, raw_s, raw_h, out, extract_format=args.extract_format,
                          database=args.database, buckets=args.buckets)
        result = {"sessions": paths.sessions, "purchases": paths.purchases, "events": paths.events,
                  "quality": paths.quality, "findings": paths.findings, "extracts": paths.extracts,
                  "tables": paths.tables}
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
