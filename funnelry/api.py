"""FunnelAnalysis: the operators bound to one dataset, for interactive use.

Every method returns a lazy DataFrame (nothing runs until an action); the
clean sessions are built once per instance and reused by every metric.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import cleaning, funnel, nested, reports, stats
from .session import Scratch, materialize
from .sources import day_tables
from .spec import DEFAULT_SPEC, FunnelSpec


@dataclass
class FunnelAnalysis:
    """Flat input: raw sessions + hits (+ products). Nested input: ``from_nested``."""
    raw_sessions: DataFrame | None = None
    hits: DataFrame | None = None
    products: DataFrame | None = None
    spec: FunnelSpec = DEFAULT_SPEC
    _sessions: DataFrame | None = field(default=None, repr=False)
    _scratch: Scratch | None = field(default=None, repr=False)

    @classmethod
    def from_nested(cls, nested_sessions: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                    date_from: str | None = None, date_to: str | None = None) -> "FunnelAnalysis":
        """Start from nested session records (flags from the hits array)."""
        flat = nested.flatten_nested(nested_sessions, spec, date_from, date_to)
        return cls(spec=spec, _sessions=flat)

    @classmethod
    def from_day_tables(cls, spark: SparkSession, root: str, date_from: str | None = None, date_to: str | None = None,
                        spec: FunnelSpec = DEFAULT_SPEC, **options) -> "FunnelAnalysis":
        """Start from a table a day (``ga_sessions_yyyyMMdd``); ``options`` go to ``read_day_tables``."""
        return cls.from_nested(day_tables.read_day_tables(spark, root, date_from, date_to, **options), spec)

    @classmethod
    def from_clean(cls, sessions: DataFrame, raw_sessions: DataFrame | None = None,
                   hits: DataFrame | None = None, products: DataFrame | None = None,
                   spec: FunnelSpec = DEFAULT_SPEC) -> "FunnelAnalysis":
        """Start from already-clean sessions (e.g. a processed table)."""
        return cls(raw_sessions=raw_sessions, hits=hits, products=products, spec=spec, _sessions=sessions)

    def _flat(self) -> tuple[DataFrame, DataFrame]:
        if self.raw_sessions is None or self.hits is None:
            raise ValueError("needs flat raw sessions and hits")
        return self.raw_sessions, self.hits

    def materialize(self) -> "FunnelAnalysis":
        """Write the clean sessions once (shared checkpoint folder) and reuse them.

        Every later metric scans that session-grain Parquet table instead of
        re-aggregating the hits: one pass over raw data for any number of
        questions. ``release`` empties the table again.
        """
        self._scratch = Scratch(self.sessions().sparkSession)
        self._sessions = materialize(self.sessions(), "funnel-sessions", self._scratch)
        return self

    def release(self) -> None:
        """Empty the table that ``materialize`` wrote; this object can't be used afterwards."""
        if self._scratch is not None:
            self._scratch.__exit__(None, None, None)
            self._scratch = self._sessions = None

    # --- clean / transform ----------------------------------------------------
    def sessions(self) -> DataFrame:
        if self._sessions is None:
            raw, hits = self._flat()
            self._sessions = cleaning.clean_sessions(raw, hits, self.spec)
        return self._sessions

    def quality(self) -> DataFrame:
        return cleaning.quality_report(*self._flat())

    def purchases(self) -> DataFrame:
        raw, hits = self._flat()
        return cleaning.purchase_lines(hits, raw, self.spec)

    def events(self) -> DataFrame:
        raw, hits = self._flat()
        return cleaning.event_log(hits, raw, self.spec)

    # --- funnel ---------------------------------------------------------------
    def funnel(self, by: tuple[str, ...] = ()) -> DataFrame:
        return funnel.funnel_frame(self.sessions(), self.spec, by)

    def stages(self) -> DataFrame:
        return funnel.funnel_stage(self.sessions(), self.spec)

    def biggest_leak(self) -> DataFrame:
        return funnel.biggest_leak(self.sessions(), self.spec)

    def rates(self, by: str = "device") -> DataFrame:
        return funnel.segment_rates(self.sessions(), by, self.spec)

    def counts(self, by: str = "device") -> DataFrame:
        return funnel.funnel_by_segment(self.sessions(), by, self.spec)

    def performance(self, by: str = "channel") -> DataFrame:
        return funnel.channel_performance(self.sessions(), by, self.spec)

    def matrix(self, rows: str = "device", cols: str = "channel") -> DataFrame:
        return funnel.segment_matrix(self.sessions(), rows, cols, self.spec)

    def worst_pockets(self, k: int = 10) -> DataFrame:
        return funnel.worst_pockets(self.sessions(), k, spec=self.spec)

    def daily(self, by: tuple[str, ...] = ()) -> DataFrame:
        return funnel.daily_trend(self.sessions(), self.spec, by)

    def categories(self) -> DataFrame:
        if self.products is not None and self.hits is not None:
            return funnel.category_revenue_from_hits(self.hits, self.products, spec=self.spec)
        return funnel.category_revenue(self.purchases())

    # --- statistics and reports -------------------------------------------------
    def ztest(self, seg: str = "device", a: str = "desktop", b: str = "mobile") -> DataFrame:
        return stats.two_proportion_test(self.sessions(), seg, a, b, self.spec.purchase.flag)

    def opportunity(self, seg: str = "device", hi: str = "desktop", lo: str = "mobile",
                    share: float = 0.5, periods_per_year: float = 12 / 3) -> DataFrame:
        return stats.gap_opportunity(self.sessions(), seg, hi, lo, share, periods_per_year, self.spec.purchase.flag)

    def totals(self) -> DataFrame:
        return reports.totals(self.sessions(), self.spec)

    def kpis(self) -> DataFrame:
        return reports.kpi_measures(funnel.channel_performance(self.sessions(), spec=self.spec, keep_micros=True))

    def cube(self) -> DataFrame:
        return reports.metric_cube(self.sessions(), self.spec)

    def findings(self, **kw) -> DataFrame:
        return reports.findings(self.sessions(), self.spec, **kw)
