"""Time-series panels on Spark: gaps, resampling, past-only features, backtests.

Every operator takes and returns a Spark DataFrame that holds a *panel*: key
columns naming the series, one timestamp column, and measures.
"""

from chronopanel.panel import Panel, PanelError, step_seconds

__all__ = ["Panel", "PanelError", "step_seconds"]
