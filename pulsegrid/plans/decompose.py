"""Split a daily signal into what training and sleep explain and the rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import squared
from ..operators.aggregates import daily_load
from ..operators.clean import clean_daily
from ..operators.joins import full_join, spine_join
from ..operators.linear import apply_coefficients, ols_gram
from ..operators.windows import top_k, trailing
from ..session import keep
from .features import order_of

# Fixed values
DECOMPOSE_TARGETS = [("avg_stress", "stress"), ("resting_hr", "rhr")]
DECOMPOSE_FEATURES = [
    "distance_today_km",
    "distance_7d_km",
    "distance_28d_km",
    "distance_7d_km_sq",
    "distance_90d_km",
    "cross_train_today_km",
    "cross_train_7d_km",
    "sleep_hours_last_night",
    "sleep_hours_prior_7d",
]
MIN_FIT_ROWS = 100


def load_features(
    frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",), d: str = "date", frame: str = "rows"
) -> DataFrame:
    """Daily spine with training-load and sleep features; rest days carry zero load."""
    by = list(by)
    raw = frames["daily_health"]
    daily = clean_daily(raw, by, order_of(raw, ["ingest_seq"], d), d)
    load = daily_load(frames["activities"], by, d)
    zero = {"distance_today_km": 0.0, "cross_train_today_km": 0.0}
    spine = spine_join(daily, load, [*by, d], zero).withColumn("sleep_hours", F.col("sleep_seconds") / 3600.0)

    def before(c: str, n: int, fn: str, need: int):
        return trailing(c, by, d, n, fn, need, shift=1, frame=frame)

    return spine.withColumns(
        {
            "distance_7d_km": before("distance_today_km", 7, "sum", 7),
            "distance_28d_km": before("distance_today_km", 28, "sum", 28),
            "distance_90d_km": before("distance_today_km", 90, "sum", 90),
            "cross_train_7d_km": before("cross_train_today_km", 7, "sum", 7),
            "sleep_hours_prior_7d": before("sleep_hours", 7, "avg", 5),
            "sleep_hours_last_night": F.col("sleep_hours"),
        }
    ).withColumn("distance_7d_km_sq", squared(F.col("distance_7d_km")))


def fit_one(
    spine: DataFrame,
    target: str,
    feats: Sequence[str] = DECOMPOSE_FEATURES,
    by: Sequence[str] = ("profile_id",),
    d: str = "date",
    min_n: int = MIN_FIT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Coefficients per entity and the rows with ``actual, fitted, residual``."""
    clean = spine.select(*by, d, *feats, F.col(target).cast("double").alias("actual")).dropna(subset=[*feats, "actual"])
    coefs = ols_gram(clean, feats, "actual", by, min_n)
    rows = apply_coefficients(clean, coefs, feats, by, "fitted")
    return coefs, rows.withColumn("residual", F.col("actual") - F.col("fitted"))


def fit_report(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row count, R², target mean and residual statistics."""
    r = F.col("residual")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        stats.r_squared(F.col("actual"), F.col("fitted")).alias("r_squared"),
        F.avg("actual").alias("target_mean"),
        F.avg(F.abs(r)).alias("residual_mae"),
        F.min(r).alias("residual_min"),
        F.max(r).alias("residual_max"),
    )


def top_residuals(rows: DataFrame, by: Sequence[str], d: str = "date", k: int = 10) -> DataFrame:
    return top_k(rows, by, [F.desc("residual"), F.asc(d)], k, rank="rank").select(
        *by, "rank", d, "actual", "fitted", "residual"
    )


def decompose(
    frames: Mapping[str, DataFrame],
    by: Sequence[str] = ("profile_id",),
    d: str = "date",
    targets: Sequence[tuple[str, str]] = DECOMPOSE_TARGETS,
    feats: Sequence[str] = DECOMPOSE_FEATURES,
    min_n: int = MIN_FIT_ROWS,
) -> dict[str, DataFrame]:
    """Coefficients, fit statistics, top residual days and the decomposed daily table."""
    by = list(by)
    spine = keep(load_features(frames, by, d).select(*by, d, *feats, *[t for t, _ in targets]))
    before = spine.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"))
    coefs, reports, tops, parts = [], [], [], []
    for target, label in targets:
        c, rows = fit_one(spine, target, feats, by, d, min_n)
        name = F.lit(label).alias("target")
        coefs.append(c.select(name, "*"))
        # rows before and after dropping incomplete days
        fit = fit_report(rows, by).join(before, by).withColumn("dropped", F.col("rows_before") - F.col("n"))
        reports.append(fit.select(name, "*"))
        tops.append(top_residuals(rows, by, d).select(name, "*"))
        parts.append(
            rows.select(
                *by,
                d,
                F.col("actual").alias(label),
                F.col("fitted").alias(f"{label}_training"),
                F.col("residual").alias(f"{label}_external"),
            )
        )

    def stack(dfs: list[DataFrame]) -> DataFrame:
        out = dfs[0]
        for df in dfs[1:]:
            out = out.unionByName(df)
        return out

    return {
        "coefficients": stack(coefs),
        "fit": stack(reports),
        "top_residuals": stack(tops),
        "decomposed_health": full_join(parts, [*by, d]),
    }
