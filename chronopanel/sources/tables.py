"""Parquet, CSV and JSON results, and the feature table with its provenance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.panel import Panel, PanelError
from chronopanel.plans.units import chunk_of, small_join

PREDICTION_SCHEMA = "series_id string, ts timestamp_ntz, y_true double, y_pred double"


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_panel(df: DataFrame, panel: Panel, path: str, mode: str = "overwrite") -> None:
    """Snappy parquet, one folder per month, clustered by series and time inside each file.

    Rows are spread by series and time chunk, so a long series fills many files.
    """
    month = F.date_format(panel.ts, "yyyy-MM")
    (
        df.withColumn("month_of", month).withColumn("__c", chunk_of(panel))
        .repartition(*panel.keys, "month_of", "__c").drop("__c")
        .sortWithinPartitions("month_of", *panel.keys, panel.ts)
        .write.mode(mode).option("compression", "snappy").partitionBy("month_of").parquet(path)
    )


def read_panel(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """A table from `write_panel`; ``months`` ("2024-01") prunes folders."""
    df = spark.read.parquet(path)
    if months is not None:
        df = df.filter(F.col("month_of").cast("string").isin(list(months)))
    return df.drop("month_of")


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Small result tables as CSV with a header, or JSON lines."""
    if fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).json(path)
    else:
        raise PanelError(f"unknown format {fmt!r}")


def read_results(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files in one folder per model and fold."""
    df.write.mode(mode).option("header", True).partitionBy("model", "fold").csv(path)


def read_predictions(spark: SparkSession, path: str, n_folds: int | None = None, columns: str = PREDICTION_SCHEMA) -> DataFrame:
    """All models' predictions as one long table; with ``n_folds``, only models that have every fold.

    ``columns`` is the schema of the files, for panels with other keys.
    """
    schema = f"{columns}, model string, fold int"
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df if n_folds is None else complete_models(df, n_folds)


def complete_models(predictions: DataFrame, n_folds: int) -> DataFrame:
    """Leave out a model that lacks any fold."""
    whole = (
        predictions.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("model").agg(F.count(F.lit(1)).alias("folds"))
        .filter(F.col("folds") == n_folds).select("model")
    )
    return small_join(predictions, whole, ["model"], "left_semi")


# --- provenance -------------------------------------------------------------------

def parameter_hash(parameters: Mapping[str, Any]) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(dict(parameters), sort_keys=True, default=str).encode()).hexdigest()


def save_features(
    matrix: DataFrame, panel: Panel, target: str, path: str, parameters: Mapping[str, Any],
    unsafe_dropped: int = 0, strict: bool = True,
) -> DataFrame:
    """Write the matrix and a one-row description next to it; returns the description."""
    spark = matrix.sparkSession
    write_panel(matrix, panel, f"{path}/data")
    features = [c for c in matrix.columns if c not in {*panel.keys, panel.ts, target}]
    stored = spark.read.parquet(f"{path}/data")
    meta = stored.agg(
        F.lit(parameter_hash(parameters)).alias("config_hash"),
        F.lit(target).alias("target_column"),
        F.lit(panel.freq).alias("target_frequency"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(features)).alias("n_features"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        F.min(panel.ts).alias("date_range_start"),
        F.max(panel.ts).alias("date_range_end"),
        F.lit(unsafe_dropped).alias("unsafe_inputs_dropped"),
        F.lit(strict).alias("strict_leakage_safe"),
        F.current_timestamp().alias("built_at_utc"),
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return spark.read.json(f"{path}/metadata")


def load_features(spark: SparkSession, path: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """Read a saved matrix; refuses one that was built with other parameters."""
    if parameters is not None:
        built = spark.read.json(f"{path}/metadata").select("config_hash").first()
        want = parameter_hash(parameters)
        if built is None or built.config_hash != want:
            raise PanelError(f"features were built with other parameters ({built and built.config_hash[:12]} vs {want[:12]})")
    return read_panel(spark, f"{path}/data")
