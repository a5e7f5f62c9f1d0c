"""Static guards on the library source: no driver-side collection, no
localCheckpoint, no cross joins, no row-at-a-time Python UDFs, and broadcast
hints only where the size is bounded by construction."""

import re
from pathlib import Path

PKG = Path(__file__).resolve().parents[1] / "funnelry"
SOURCES = {p: p.read_text() for p in PKG.rglob("*.py") if p.parent.name != "llm"}

FORBIDDEN = [r"\.collect\(", r"\.toPandas\(", r"localCheckpoint", r"crossJoin", r"\bF\.udf\(", r"@udf\b",
             r"pandas_udf", r"\.rdd\b"]


def test_no_forbidden_patterns():
    hits = [(p.name, pat) for p, text in SOURCES.items() for pat in FORBIDDEN if re.search(pat, text)]
    assert hits == []


def test_no_broadcast_hint_and_no_probe():
    assert [p.name for p, text in SOURCES.items() if "F.broadcast(" in text or ".first()" in text] == []
