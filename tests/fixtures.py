"""Literal unit fixture covering the semantic traps (FIXTURES.md section 5)."""

from funnelry import schema as S

SESSIONS = [
    # fullVisitorId, visitId, session_id, date, channel, device, country, pv, bounces, hits, tx, micros
    ("v1", 1, "s1", "20161101", "Referral", "desktop", "US", 2, 0, 5, 1, 89990000),
    ("v2", 2, "s2", "20161101", "Direct", "desktop", "US", 3, 0, 4, 0, None),
    ("v2", 3, "s3", "20161102", "Social", "mobile", "IN", 1, 0, 2, None, None),
    ("v3", 4, "s4", "20161102", "Social", "mobile", "US", 2, 0, 3, 1, 10500000),
    ("v4", 5, "s5", "20161102", "Direct", "tablet", "DE", 1, 1, 1, 0, None),
    ("v5", 6, "s6", "20161103", None, "desktop", "JP", 1, 0, 2, 0, None),
]

A = ("A", "Apparel", 55.07)
B = ("B", "Bags", 20.00)
HITS = []
for sid, codes, prod in [("s1", [2, 3, 5, 6], A), ("s2", [2, 2, 3], B), ("s3", [3], B), ("s4", [2, 5], A),
                         ("s6", [0], B)]:
    for i, c in enumerate(codes, start=1):
        HITS.append((sid, i, "EVENT", c, prod[0], prod[1], prod[2]))
HITS.append(("s9", 1, "EVENT", 6, "Z", None, 0.0))

PRODUCTS = [("A", "Apparel", 55.07), ("B", "Bags", 20.00)]


def frames(spark):
    s = spark.createDataFrame(SESSIONS, S.RAW_SESSIONS)
    h = spark.createDataFrame(HITS, S.RAW_HITS)
    p = spark.createDataFrame(PRODUCTS, S.PRODUCTS)
    return s, h, p


def clean(spark):
    from funnelry.operators.cleaning import clean_sessions
    s, h, _ = frames(spark)
    return clean_sessions(s, h)
