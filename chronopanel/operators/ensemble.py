"""Stacking: a ridge regression over aligned forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.evaluate import align_models
from chronopanel.panel import PanelError

ALPHA = 1.0


@dataclass(frozen=True)
class Stack:
    models: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self, wide: DataFrame, floor: float | None = 0.0) -> DataFrame:
        y = F.lit(self.intercept)
        for m, w in zip(self.models, self.weights):
            y = y + F.col(f"`{m}`") * F.lit(w)
        return wide.withColumn("y_pred", y if floor is None else F.greatest(y, F.lit(floor)))

    def coefficients(self, spark) -> DataFrame:
        rows = [*zip(self.models, self.weights), ("intercept", self.intercept)]
        return spark.createDataFrame([(m, float(w)) for m, w in rows], "base_model string, coefficient double")


def ridge(train: DataFrame, models: Sequence[str], alpha: float = ALPHA, y: str = "y_true") -> Stack:
    """Closed-form ridge with a free intercept.

    One aggregation over the rows: means and covariances, which Spark merges without cancellation. Only
    those, one number per pair of models, come to the driver.
    """
    names = [*models, y]
    col = lambda i: F.col(f"`{names[i]}`")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = train.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(col(i)).alias(f"m{i}") for i in range(len(names))],
        *[F.covar_pop(col(i), col(j)).alias(f"s{i}_{j}") for i, j in pairs],
    ).first()
    if not sums.n:
        raise PanelError("no rows to train the stack on")
    mu = [sums[f"m{i}"] for i in range(len(names))]
    g = np.zeros((len(names), len(names)))
    for i, j in pairs:
        g[i, j] = g[j, i] = sums[f"s{i}_{j}"] * sums.n
    p = len(models)
    w = np.linalg.solve(g[:p, :p] + alpha * np.eye(p), g[:p, p])
    return Stack(tuple(models), tuple(float(v) for v in w), float(mu[p] - w @ np.array(mu[:p])))


def stack(
    predictions: DataFrame,
    models: Sequence[str],
    holdout: int,
    alpha: float = ALPHA,
    floor: float | None = 0.0,
    on: Sequence[str] = ("series_id", "fold", "ts"),
    name: str = "stacking_ridge",
) -> tuple[DataFrame, Stack]:
    """Train on the folds before ``holdout`` and predict it; forecasts are clipped at ``floor``."""
    wide = align_models(predictions, models, on)
    fitted = ridge(wide.filter(F.col("fold") < holdout), models, alpha)
    test = fitted.predict(wide.filter(F.col("fold") == holdout), floor)
    return test.select(*on, F.lit(name).alias("model"), "y_true", "y_pred"), fitted
