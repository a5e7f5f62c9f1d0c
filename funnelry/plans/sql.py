"""SQL-text versions of the funnel queries, run by ``spark.sql`` over views.

The texts follow the relational form of the metrics (one row per session with
0/1 flags) and are planned by Catalyst exactly like the DataFrame versions.
Views are passed as DataFrame arguments (``spark.sql(text, sessions=df)``),
so no global temp-view name is shared between callers.

Spark differences handled in the text: ``SUM`` of a boolean is not allowed
(flags are 0/1 ints in the view), ``1.0 * a / b`` would be DECIMAL (we cast to
DOUBLE), ANSI division by zero raises (``NULLIF`` guards every divisor), and
money is summed as integer micros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import usd_to_micros
from ..spec import DEFAULT_SPEC, FunnelSpec


def sessions_view(sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Clean sessions with 0/1 integer flags (P7), as a relational table."""
    flags = set(spec.flags)
    return sessions.select(*[F.col(c).cast("int").alias(c) if c in flags else F.col(c)
                             for c in sessions.columns])


def purchases_view(purchases: DataFrame) -> DataFrame:
    return purchases.select("*", usd_to_micros("item_value").alias("item_micros"))


# --- Building blocks: every text below is put together from a FunnelSpec -------
def _share(part: str, whole: str, name: str = "", places: int | None = 4) -> str:
    """part / whole as DOUBLE, NULL for an empty whole; rounded and named on request."""
    text = f"CAST({part} AS DOUBLE) / NULLIF({whole}, 0)"
    if places is not None:
        text = f"ROUND({text}, {places})"
    return f"{text} AS {name}" if name else text


def _money(micros: str = "revenue_micros") -> str:
    return f"COALESCE(SUM({micros}), 0) / 1e6"


def _reached(spec: FunnelSpec) -> list[str]:
    """COUNT(*) and the number of sessions at each stage."""
    return ["COUNT(*)", *[f"SUM({flag})" for flag in spec.flags]]


def _step_rates(spec: FunnelSpec, entry_name: str = "") -> list[str]:
    """The rate of each step; the step from the entry only under ``entry_name``."""
    reached, names = _reached(spec), list(spec.step_names)
    steps = [_share(now, before, f"{a}_to_{b}")
             for now, before, a, b in zip(reached[2:], reached[1:], names, names[1:])]
    if entry_name:
        steps.insert(0, _share(reached[1], reached[0], f"{entry_name}_to_{names[0]}"))
    return [*steps, _share(reached[-1], reached[0], "overall_conversion")]


def _statement(columns: list[str], table: str = "sessions", keys: tuple[str, ...] = (), order: list[str] = (),
               limit: str = "") -> str:
    parts = [f"SELECT {', '.join([*keys, *columns])}", f"FROM {{{table}}}"]
    if keys:
        parts.append(f"GROUP BY {', '.join(keys)}")
    if order:
        parts.append(f"ORDER BY {', '.join([*order, *[f'{k} ASC NULLS LAST' for k in keys]])}")
    if limit:
        parts.append(f"LIMIT {{{limit}}}")
    return "\n".join(parts)


def stage_union(spec: FunnelSpec = DEFAULT_SPEC) -> str:
    """One row per stage, a UNION ALL of one-row aggregates. Each is a scalar
    subquery: the optimizer merges those over one input into a single scan."""
    return "\nUNION ALL ".join(
        f"SELECT '{label}' AS stage, (SELECT {count} FROM {{sessions}}) AS cnt"
        for label, count in zip(spec.labels, _reached(spec)))


def step_conversion(spec: FunnelSpec = DEFAULT_SPEC) -> str:
    return _statement(_step_rates(spec, entry_name="session"))


def segment_rates(by: str, spec: FunnelSpec = DEFAULT_SPEC) -> str:
    """Step rates per segment, best conversion first."""
    overall = _share(_reached(spec)[-1], "COUNT(*)", places=None)
    return _statement(["COUNT(*) AS sessions", *_step_rates(spec)], keys=(by,), order=[f"{overall} DESC"])


def segment_performance(keys: tuple[str, ...], spec: FunnelSpec = DEFAULT_SPEC, orders: bool = True,
                        revenue: bool = True, per_session: bool = True, order: str = "rate DESC", limit: str = "") -> str:
    """Sessions, orders, conversion and revenue per segment. ``order`` sorts by the
    unrounded ``rate`` first, or by the keys alone if empty."""
    buyers = f"SUM({spec.purchase.flag})"
    columns = ["COUNT(*) AS sessions"]
    if orders:
        columns.append(f"{buyers} AS orders")
    columns.append(_share(buyers, "COUNT(*)", "conversion_rate"))
    if revenue:
        columns.append(f"ROUND({_money()}, 2) AS revenue")
    if revenue and per_session:
        columns.append(f"ROUND({_money()} / COUNT(*), 3) AS revenue_per_session")
    rate = _share(buyers, "COUNT(*)", places=None)
    return _statement(columns, keys=keys, order=[order.replace("rate", rate)] if order else [f"{keys[0]} ASC NULLS LAST"],
                      limit=limit)


def stage_totals(spec: FunnelSpec = DEFAULT_SPEC, names: tuple[str, ...] = (
        "product_views", "add_to_carts", "checkouts", "purchases")) -> str:
    """The whole funnel in one row: counts under ``names``, then step rates."""
    counts = [f"{count} AS {name}" for count, name in zip(_reached(spec), ("sessions", *names))]
    return _statement([*counts, *_step_rates(spec)])


def category_revenue_text() -> str:
    items = _share("SUM(item_micros)", "COUNT(item_micros)", places=None)
    return _statement(["COUNT(*) AS orders", f"ROUND({_money('item_micros')}, 2) AS revenue",
                       f"ROUND({items} / 1e6, 2) AS avg_item_value"], table="purchases", keys=("category",),
                      order=["COALESCE(SUM(item_micros), 0) DESC"])


# --- The texts of the default funnel ---------------------------------------------
STAGE_UNION = stage_union()
STEP_CONVERSION = step_conversion()
DEVICE_RATES = NESTED_DEVICE = segment_rates("device")
CHANNEL_PERFORMANCE = NESTED_CHANNEL = segment_performance(("channel",))
NESTED_MATRIX = segment_performance(("device", "channel"), orders=False, revenue=False, order="rate ASC")
WORST_POCKETS = segment_performance(("device", "channel"), orders=False, revenue=False, order="rate ASC", limit="k")
DAILY_TREND_HEAD = segment_performance(("date",), per_session=False, order="", limit="n")
CATEGORY_REVENUE = category_revenue_text()
NESTED_FUNNEL = stage_totals()


def run_on_tables(spark: SparkSession, text: str, sessions: str = "sessions", purchases: str = "purchases",
                  **params) -> DataFrame:
    """Run one of the texts against catalog tables (see sinks.save_relational_tables)."""
    return spark.sql(text.format(sessions=sessions, purchases=purchases, **params))


def run(spark: SparkSession, text: str, sessions: DataFrame | None = None,
        purchases: DataFrame | None = None, **params) -> DataFrame:
    """Run one of the texts with DataFrame-valued views and literal params."""
    frames = {}
    if sessions is not None:
        frames["sessions"] = sessions
    if purchases is not None:
        frames["purchases"] = purchases
    return spark.sql(text, **frames, **params)
