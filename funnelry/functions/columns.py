"""Column-expression building blocks (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import MICROS, FunnelSpec


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def flag_count(flag: str | Column) -> Column:
    """Sum of a boolean flag as BIGINT; 0 (not NULL) on empty input."""
    return F.coalesce(F.sum(col_(flag).cast("long")), F.lit(0).cast("long"))


def micros_to_usd(micros: str | Column) -> Column:
    """Integer micros to currency units; NULL micros count as 0."""
    return F.coalesce(col_(micros), F.lit(0)).cast("double") / F.lit(float(MICROS))


def usd_to_micros(amount: str | Column) -> Column:
    """Currency to integer micros, rounded (not truncated) to the nearest micro."""
    return F.round(col_(amount) * F.lit(MICROS)).cast("long")


def sum_micros(micros: str | Column) -> Column:
    """Exact revenue sum kept in integer micros; 0 on empty input."""
    return F.coalesce(F.sum(col_(micros)), F.lit(0).cast("long"))


def parse_yyyymmdd(c: str | Column, tolerant: bool = False) -> Column:
    """The date of yyyyMMdd text. Text that is no date raises (under ANSI), or is NULL if ``tolerant``."""
    text = col_(c).cast("string")
    if not tolerant:
        return F.to_date(text, "yyyyMMdd")
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))


def clamp(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col_(c), F.lit(lo)), F.lit(hi))


def stage_code_to_event(code: str | Column, spec: FunnelSpec) -> Column:
    """Action code -> stage event name; unmapped codes give NULL."""
    expr = None
    for s in spec.stages:
        expr = (F.when(col_(code) == s.code, F.lit(s.event)) if expr is None
                else expr.when(col_(code) == s.code, F.lit(s.event)))
    return expr


# --- Normal upper tail --------------------------------------------------------
#: From here on the continued fraction is used, below it the series; terms of either.
TAIL_FROM, SERIES_TERMS, FRACTION_TERMS = 2.5, 48, 240


def _tail(v: Column, half: float, tail_from: float) -> Column:
    """2 sqrt(half / pi) times the integral of exp(-half t^2) from v >= 0 on, in full double precision.

    Below ``tail_from`` it is 1 less the series of the body, whose terms are all positive; above,
    the continued fraction of Mills' ratio. exp(-half v^2) is taken at a rounded v, whose square is exact, and mended
    by the rest, as v^2 itself would lose digits for large v.
    """
    lead = 2 * math.sqrt(half / math.pi)
    square = F.lit(2 * half) * v * v
    near = F.floor(v * 16) / 16
    bell = F.exp(F.lit(-half) * near * near) * F.exp(F.lit(-half) * (v - near) * (v + near))
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    body = F.aggregate(down(SERIES_TERMS), F.lit(1.0), lambda s, n: 1.0 + square / (2 * n + 1) * s)
    mills = F.aggregate(down(FRACTION_TERMS), v, lambda s, n: v + n / (F.lit(2 * half) * s))
    return (F.when(F.isnan(v), v).when(v < tail_from, 1.0 - F.lit(lead) * v * bell * body)
            .when(v < 64, F.lit(lead / (2 * half)) * bell / mills).otherwise(F.lit(0.0)))


def _once(c: Column, function) -> Column:
    """``function`` of a column, which is computed once however often the function names it."""
    return F.transform(F.array(c), function)[0]


def erfc_col(x: Column) -> Column:
    """erfc(x) for x >= 0."""
    return F.when(x.isNotNull(), _once(x.cast("double"), lambda v: _tail(v, 1.0, TAIL_FROM / math.sqrt(2))))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value 2*(1-Phi(|z|)) = erfc(|z|/sqrt 2), from z directly.

    Written as the upper tail so that it does not cancel to 0 for large |z| (z = 19.3
    gives 8e-83, not 0); NULL for a NULL z.
    """
    return F.when(z.isNotNull(), _once(F.abs(z).cast("double"), lambda v: _tail(v, 0.5, TAIL_FROM)))


# --- Labels -------------------------------------------------------------------
def thousands(c: str | Column) -> Column:
    """Integer with thousands separators: 71456 -> '71,456'."""
    return F.format_number(col_(c).cast("long"), 0)


def percent_label(num: str | Column, den: str | Column, decimals: int = 1) -> Column:
    """num/den as a percent string with ``decimals`` places, rounded half up.

    Computed in exact integer arithmetic so that every engine prints the same
    digits: '47.6%'. NULL when den is 0.
    """
    scale = 10 ** decimals
    n, d = col_(num).cast("long"), col_(den).cast("long")
    units = _int_div(n * F.lit(200 * scale) + d, d * F.lit(2))
    whole = _int_div(units, F.lit(scale))
    frac = F.lpad((units % F.lit(scale)).cast("string"), decimals, "0")
    return F.when(d > 0, F.concat(whole.cast("string"), F.lit("."), frac, F.lit("%")))


def _int_div(a: Column, b: Column) -> Column:
    """Integral division of non-negative longs (SQL ``div``), exact at any size."""
    return F.when(b > 0, F.call_function("div", a, b))
