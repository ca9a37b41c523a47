"""Forecast error metrics as aggregate expressions over two columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[str, str], Column]

# Fixed value: floor of the percentage denominator in MAPE.
MAPE_FLOOR = 1e-6


def paired(y: str, yhat: str) -> Column:
    """Whether truth and forecast are both there: neither null nor NaN."""
    both = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    return both & ~F.isnan(F.col(y).cast("double")) & ~F.isnan(F.col(yhat).cast("double"))


def _truth(y: str, yhat: str) -> Column:
    return F.when(paired(y, yhat), F.col(y))


def abs_error(y: str, yhat: str) -> Column:
    """Null where the pair is incomplete, so that every metric is over the same rows."""
    return F.when(paired(y, yhat), F.abs(F.col(y) - F.col(yhat)))


def mae(y: str, yhat: str) -> Column:
    return F.avg(abs_error(y, yhat))


def rmse(y: str, yhat: str) -> Column:
    e = abs_error(y, yhat)
    return F.sqrt(F.avg(e * e))


def wape(y: str, yhat: str) -> Column:
    """Null when the total of the truth is zero."""
    return F.try_divide(F.sum(abs_error(y, yhat)), F.sum(F.abs(_truth(y, yhat))))


def smape(y: str, yhat: str) -> Column:
    """A point where both values are zero counts as zero."""
    half = F.when(paired(y, yhat), (F.abs(F.col(y)) + F.abs(F.col(yhat))) / 2)
    return F.avg(F.when(half == 0, F.lit(0.0)).otherwise(abs_error(y, yhat) / half))


def mape(y: str, yhat: str) -> Column:
    return F.avg(abs_error(y, yhat) / F.greatest(F.abs(F.col(y)), F.lit(MAPE_FLOOR))) * 100


def smape_percent(y: str, yhat: str) -> Column:
    return smape(y, yhat) * 100


# The four metrics that need only truth and forecast; MASE also needs training rows.
METRICS: dict[str, Metric] = {"MAE": mae, "RMSE": rmse, "WAPE": wape, "sMAPE": smape}
PERCENT_METRICS: dict[str, Metric] = {"MAE": mae, "RMSE": rmse, "MAPE": mape, "sMAPE": smape_percent}


def metric(name: str) -> Metric:
    """Look a metric up by name."""
    known = {**METRICS, "MAPE": mape}
    if name not in known:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(known)}")
    return known[name]
