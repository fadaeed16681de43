"""The daily feature matrix: one row per entity and day, side tables joined in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import weekday_cos, weekday_sin
from ..operators.aggregates import daily_rollup, last_row_per
from ..operators.clean import clean_daily, derive_daily, prune_sparse
from ..operators.forest import latest_rows, target_source
from ..operators.joins import spine_join
from ..operators.windows import ffill, next_row, trailing
from ..session import keep

# Feature names and their windows
DAILY_FEATURES = [
    "resting_hr",
    "sleep_hours",
    "steps",
    "active_calories",
    "avg_stress",
    "body_battery_delta",
    "hrv_last_night",
    "avg_spo2",
    "sleep_score",
]
CALENDAR_FEATURES = ["day_sin", "day_cos"]
PERFORMANCE_FEATURES = ["vo2max", "training_readiness", "endurance_score"]
ACTIVITY_FEATURES = [
    "activity_count",
    "activity_duration_sec",
    "activity_distance_m",
    "activity_calories",
    "activity_training_load",
]
WEIGHT_FEATURES = ["weight_kg", "body_fat"]
PRESSURE_FEATURES = ["systolic", "diastolic"]
ROLLING_FEATURES = [
    ("resting_hr", "avg", "resting_hr_7d_mean"),
    ("resting_hr", "std", "resting_hr_7d_std"),
    ("sleep_hours", "avg", "sleep_hours_7d_mean"),
    ("steps", "avg", "steps_7d_mean"),
    ("active_calories", "avg", "active_calories_7d_mean"),
    ("hrv_last_night", "avg", "hrv_last_night_7d_mean"),
]
# side table, features, rows a value is carried forward, tie-break within a day
SIDE_TABLES = [
    ("performance_metrics", PERFORMANCE_FEATURES, 14, ["ingest_seq"]),
    ("weight", WEIGHT_FEATURES, 30, ["timestamp_gmt", "sample_pk", "ingest_seq"]),
    ("blood_pressure", PRESSURE_FEATURES, 30, ["timestamp_gmt", "ingest_seq"]),
]


def order_of(df: DataFrame, wanted: Sequence[str], d: str = "date") -> list[str]:
    """Write-order columns that exist, falling back to the date."""
    return [c for c in wanted if c in df.columns] or [d]


def side_features(
    df: DataFrame, feats: Sequence[str], limit: int | None, ties: Sequence[str], by: Sequence[str], d: str = "date"
) -> DataFrame:
    """Last value per day, carried forward on the side table's own rows when ``limit`` is given."""
    per_day = last_row_per(df, [*by, d], order_of(df, ties, d), feats)
    per_day = per_day.withColumns({c: F.col(c).cast("double") for c in feats})
    if limit is None:
        return per_day
    return per_day.withColumns({c: ffill(c, by, d, limit) for c in feats})


def feature_frame(
    frames: Mapping[str, DataFrame],
    by: Sequence[str] = ("profile_id",),
    d: str = "date",
    fill: str = "before_join",
    frame: str = "rows",
) -> tuple[DataFrame, list[str]]:
    """All features before pruning, and their names.

    The list depends on which side tables are given. ``fill="before_join"``
    carries sparse values along the side table's rows; ``"after_join"`` along
    the daily spine. ``frame`` selects row- or calendar-exact trailing windows.
    """
    by = list(by)
    keys = [*by, d]
    raw = frames["daily_health"]
    daily = derive_daily(clean_daily(raw, by, order_of(raw, ["ingest_seq"], d), d))
    spine = daily.select(*keys, *DAILY_FEATURES).withColumns({"day_sin": weekday_sin(d), "day_cos": weekday_cos(d)})
    feats = [*DAILY_FEATURES, *CALENDAR_FEATURES]

    for name, cols, limit, ties in SIDE_TABLES[:1]:
        spine, feats = _add_side(spine, feats, frames, name, cols, limit, ties, by, d, fill)
    if frames.get("activities") is not None:
        rollup = daily_rollup(frames["activities"], by, d)
        spine = spine_join(spine, rollup, keys)
        spine = spine.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ACTIVITY_FEATURES})
        feats += ACTIVITY_FEATURES
    for name, cols, limit, ties in SIDE_TABLES[1:]:
        spine, feats = _add_side(spine, feats, frames, name, cols, limit, ties, by, d, fill)

    rolled = {out: trailing(c, by, d, 7, fn, 5, frame=frame) for c, fn, out in ROLLING_FEATURES}
    return spine.withColumns(rolled), [*feats, *rolled]


def _add_side(spine, feats, frames, name, cols, limit, ties, by, d, fill):
    df = frames.get(name)
    if df is None:
        return spine, feats
    side = side_features(df, cols, limit if fill == "before_join" else None, ties, by, d)
    spine = spine_join(spine, side, [*by, d])
    if fill == "after_join":
        spine = spine.withColumns({c: ffill(c, by, d, limit) for c in cols})
    return spine, [*feats, *cols]


def with_target(df: DataFrame, target: str, by: Sequence[str], d: str = "date") -> DataFrame:
    """Add the target: the source's value in the entity's next row."""
    source, ahead = target_source(target)
    return df.withColumn(target, next_row(F.col(source).cast("double"), by, d, ahead))


def feature_matrix(
    frames: Mapping[str, DataFrame],
    target: str,
    by: Sequence[str] = ("profile_id",),
    d: str = "date",
    max_null: float = 0.30,
    **opts,
) -> tuple[DataFrame, list[str]]:
    """Training rows: surviving features, target and date, without nulls."""
    df, feats = feature_frame(frames, by, d, **opts)
    df = keep(with_target(df, target, by, d))
    kept = prune_sparse(df, feats, max_null)
    if not kept:
        raise ValueError("every feature column exceeds the null-rate threshold")
    return df.select(*by, d, *kept, target).dropna(subset=[*kept, target]), kept


def prediction_rows(
    frames: Mapping[str, DataFrame], feats: Sequence[str], by: Sequence[str] = ("profile_id",), d: str = "date", **opts
) -> DataFrame:
    """Each entity's newest row with all features a trained model needs."""
    df, _ = feature_frame(frames, by, d, **opts)
    return latest_rows(df, feats, by, d)
