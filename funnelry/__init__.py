"""funnelry: clickstream funnel analytics on Spark DataFrames.

Sessions and hits in, one flagged row per session, then funnel, segment,
significance and revenue-opportunity metrics as lazy DataFrames.
"""

from .api import FunnelAnalysis
from .spec import DEFAULT_SPEC, FunnelSpec, Stage

__all__ = ["DEFAULT_SPEC", "FunnelAnalysis", "FunnelSpec", "Stage"]
