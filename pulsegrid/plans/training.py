"""Train, validate, explain and serve a next-day forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import require_quality
from ..operators.forest import (
    baseline_metrics,
    cv_baselines,
    forecast,
    importance_tail,
    metrics_frame,
    permutation_importance,
    target_source,
    time_series_cv,
)
from ..operators.joins import semi
from ..operators.trees import ForestModel, Settings, fit
from ..session import durable
from ..sources.sinks import load_model, save_model
from .features import feature_matrix, prediction_rows


def train(
    frames: Mapping[str, DataFrame],
    target: str,
    by: Sequence[str] = ("profile_id",),
    path: str | None = None,
    start: int = 30,
    step: int = 7,
    min_rows: int = 60,
    trained_at: str | None = None,
    settings: Settings = Settings(),
) -> dict:
    """Gate, build features, cross-validate, fit, rank features and optionally save.

    Returns the model, the kept features and the metric frames. Forest and baselines are scored on the same rows.
    """
    source, _ = target_source(target)
    good = require_quality(frames["daily_health"], by, min_rows=min_rows).select(*by).distinct()
    usable = {name: (semi(df, good, by) if name == "daily_health" else df) for name, df in frames.items()}
    matrix, feats = feature_matrix(usable, target, by)
    matrix = durable(matrix)
    out_of_fold = time_series_cv(matrix, feats, target, by, start=start, step=step, settings=settings)
    cv = metrics_frame(out_of_fold, target, "prediction").select(F.lit("forest").alias("model"), "*")
    predicted = cv_baselines(matrix, target, source if source in feats else None, by, start=start, step=step)
    metrics = cv.unionByName(baseline_metrics(predicted, target))
    model = fit(matrix, feats, target, [*by, "date"], settings)
    importance = permutation_importance(model, importance_tail(matrix, by), target, by)
    out = {"model": model, "features": feats, "metrics": metrics, "importance": importance}
    if path is not None:
        span = matrix.agg(F.count(F.lit(1)), F.min("date").cast("string"), F.max("date").cast("string")).first()
        meta = {
            "target": target,
            "feature_names": feats,
            "n_training_rows": span[0],
            "date_range": [span[1], span[2]],
            "cv_results": {r["model"]: {"mae": r["mae"], "rmse": r["rmse"], "r_squared": r["r_squared"]} for r in metrics.collect()},
            "feature_importance": [[r["feature"], r["importance"]] for r in importance.collect()],
            "hyperparams": model.describe(),
            "trained_at": trained_at,
        }
        save_model(model, meta, f"{path}/{target}")
        out["metadata"] = meta
    return out


def predict(
    spark: SparkSession, frames: Mapping[str, DataFrame], target: str, path: str, by: Sequence[str] = ("profile_id",)
) -> DataFrame:
    """Forecast for the day after each entity's newest complete row, with the model's CV error."""
    model, meta = load_model(spark, f"{path}/{target}")
    return forecast_frames(model, frames, meta["feature_names"], by).withColumns(
        {"target": F.lit(target), "cv_mae": F.lit(meta["cv_results"]["forest"]["mae"])}
    )


def forecast_frames(
    model: ForestModel, frames: Mapping[str, DataFrame], feats: Sequence[str], by: Sequence[str] = ("profile_id",)
) -> DataFrame:
    return forecast(model, prediction_rows(frames, feats, by), by)
