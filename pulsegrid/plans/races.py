"""Race retrospective: races, records, trailing features, contrast and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import (
    RUNNING_TYPES,
    distance_bucket,
    ellipsis,
    fmt_pace,
    fmt_time,
    json_is,
    json_malformed,
    pace_sec_per_km,
    predicted_pace,
    quality,
    taper,
    type_in,
)
from ..operators.aggregates import best_per, contrast, melt, reject_counts
from ..operators.clean import clean_daily
from ..operators.ranges import Range, Source, range_features_from
from ..operators.windows import top_k
from ..session import keep
from .features import order_of

# Report columns in report order
RACE_FEATURES = [
    "stress_7d",
    "stress_28d",
    "stress_12w",
    "high_stress_days_28d_pct",
    "stress_external_7d",
    "stress_external_28d",
    "stress_training_7d",
    "stress_training_28d",
    "rhr_external_7d",
    "rhr_external_28d",
    "mileage_4w_km",
    "mileage_8w_km",
    "mileage_12w_km",
    "longest_run_8w_km",
    "n_runs_4w",
    "taper_pct",
    "sleep_hours_7d",
    "sleep_hours_28d",
    "rhr_7d",
    "rhr_28d",
    "rhr_delta_7d_vs_28d",
    "hrv_7d",
    "hrv_28d",
    "hrv_12w",
    "hrv_delta_7d_vs_28d",
    "hrv_unbalanced_days_28d_pct",
    "weight_kg",
    "vo2max_at_race",
    "garmin_predicted_pace",
]
ELEVATED_STRESS = 50.0
UNBALANCED = ["UNBALANCED", "LOW"]
RACE_SECONDS = ["race_5k_sec", "race_10k_sec", "race_half_sec", "race_marathon_sec"]


def classify_activities(acts: DataFrame) -> DataFrame:
    """Running activities with bucket and the reason a row is not a usable race.

    ``reject_reason``: malformed_json, not_a_race, tiny, unrecognised_distance,
    or null for a race.
    """
    km = F.coalesce(F.col("distance_m"), F.lit(0.0)) / 1000.0
    tiny = (F.coalesce(F.col("distance_m"), F.lit(0.0)) < 100.0) | (F.coalesce(F.col("duration_sec"), F.lit(0.0)) < 60.0)
    return (
        acts.where(type_in(RUNNING_TYPES))
        .withColumns({"distance_km": km, "bucket": distance_bucket(km)})
        .withColumn(
            "reject_reason",
            F.when(json_malformed("raw_json"), F.lit("malformed_json"))
            .when(~json_is("raw_json", "$.eventType.typeKey", "race"), F.lit("not_a_race"))
            .when(tiny, F.lit("tiny"))
            .when(F.col("bucket").isNull(), F.lit("unrecognised_distance")),
        )
    )


def load_races(classified: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    return classified.where(F.col("reject_reason").isNull()).select(
        *by,
        "activity_id",
        "date",
        F.col("activity_name").alias("name"),
        "distance_km",
        "duration_sec",
        "bucket",
        pace_sec_per_km(F.col("duration_sec"), F.col("distance_km")).alias("pace"),
    )


def personal_records(races: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Best pace per entity and bucket; the earliest race wins a tie."""
    best = best_per(races, [*by, "bucket"], "pace", ["date", "activity_id"])
    return best.withColumns({"pace_text": fmt_pace(F.col("pace")), "time_text": fmt_time(F.col("duration_sec"))})


def with_quality(races: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Races with the distance to their bucket's record and the quality class."""
    best = races.groupBy(*by, "bucket").agg(F.min("pace").alias("best_pace"))
    return races.join(best, [*by, "bucket"]).withColumns(
        {
            "off_pct": F.try_divide(F.col("pace") - F.col("best_pace"), F.col("best_pace")) * 100.0,
            "quality": quality(F.col("pace"), F.col("best_pace")),
            "short_name": ellipsis("name", 50),
        }
    )


def race_features(
    races: DataFrame, frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",)
) -> DataFrame:
    """The 29 trailing features of every race; all windows end the day before it."""
    by = list(by)
    runs = (
        frames["activities"]
        .where(type_in(RUNNING_TYPES))
        .select(*by, "date", (F.col("distance_m").cast("double") / 1000.0).alias("km"))
    )
    sources: list[Source] = [
        (
            runs,
            [
                Range("mileage_4w_km", "sum", "km", 28),
                Range("mileage_8w_km", "sum", "km", 56),
                Range("mileage_12w_km", "sum", "km", 84),
                Range("longest_run_8w_km", "max", "km", 56),
                Range("n_runs_4w", "count", None, 28),
                Range("_last_week", "sum", "km", 7),
                Range("_prior_three", "sum", "km", 28, 8),
            ],
            [],
        )
    ]
    made = {"taper_pct": taper(F.col("_last_week"), F.col("_prior_three")), "n_runs_4w": F.col("n_runs_4w").cast("double")}
    if frames.get("daily_health") is not None:
        raw = frames["daily_health"]
        means = [
            ("_sleep_7", "sleep_seconds", 7),
            ("_sleep_28", "sleep_seconds", 28),
            ("stress_7d", "avg_stress", 7),
            ("stress_28d", "avg_stress", 28),
            ("stress_12w", "avg_stress", 84),
            ("rhr_7d", "resting_hr", 7),
            ("rhr_28d", "resting_hr", 28),
            ("hrv_7d", "hrv_last_night", 7),
            ("hrv_28d", "hrv_last_night", 28),
            ("hrv_12w", "hrv_last_night", 84),
        ]
        shares = [
            Range("high_stress_days_28d_pct", "share_above", "avg_stress", 28, arg=ELEVATED_STRESS),
            Range("hrv_unbalanced_days_28d_pct", "share_in", "hrv_status", 28, arg=UNBALANCED),
        ]
        daily = clean_daily(raw, by, order_of(raw, ["ingest_seq"]))
        sources.append((daily, [*[Range(n, "mean", c, k) for n, c, k in means], *shares], []))
        made |= {
            "sleep_hours_7d": F.col("_sleep_7") / 3600.0,
            "sleep_hours_28d": F.col("_sleep_28") / 3600.0,
            "rhr_delta_7d_vs_28d": F.col("rhr_7d") - F.col("rhr_28d"),
            "hrv_delta_7d_vs_28d": F.col("hrv_7d") - F.col("hrv_28d"),
        }
    if frames.get("decomposed_health") is not None:
        parts = ["stress_external", "stress_training", "rhr_external"]
        sources.append((frames["decomposed_health"], [Range(f"{c}_{k}d", "mean", c, k) for c in parts for k in (7, 28)], []))
    if frames.get("weight") is not None:
        w = frames["weight"]
        sources.append((w, [Range("weight_kg", "last", "weight_kg", 30)], order_of(w, ["timestamp_gmt", "sample_pk", "ingest_seq"])))
    if frames.get("performance_metrics") is not None:
        p = frames["performance_metrics"]
        specs = [Range("vo2max_at_race", "last", "vo2max", 30), *[Range(f"_{c}", "last", c, 30) for c in RACE_SECONDS]]
        sources.append((p, specs, order_of(p, ["ingest_seq"])))
        made["garmin_predicted_pace"] = predicted_pace(F.col("bucket"), {c: F.col(f"_{c}") for c in RACE_SECONDS})

    out = range_features_from(races, sources, by).withColumns(made)
    missing = {f: F.lit(None).cast("double") for f in RACE_FEATURES if f not in out.columns}
    return out.withColumns(missing).select(*races.columns, *RACE_FEATURES)


def feature_correlations(
    df: DataFrame, feats: Sequence[str], y: str, by: Sequence[str], min_n: int = 3, top: int | None = 12
) -> DataFrame:
    """Pearson r, slope and n of every feature against ``y``, strongest first per group."""
    x, yy = F.col("value"), F.col("_y")
    out = (
        melt(df, [*by, F.col(y).alias("_y")], feats)
        .groupBy(*by, "feature")
        .agg(stats.pair_count(x, yy).alias("n"), stats.corr_safe(x, yy).alias("r"), stats.slope_safe(x, yy).alias("slope"))
        .where((F.col("n") >= min_n) & F.col("r").isNotNull() & F.col("slope").isNotNull())
    )
    return top_k(out, by, [F.desc(F.abs("r")), F.asc("feature")], top) if top else out


def races_report(frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",)) -> dict[str, DataFrame]:
    by = list(by)
    classified = classify_activities(frames["activities"])
    races = keep(load_races(classified, by))
    graded = with_quality(races, by)
    # contrasts and correlations need two races in the bucket
    several = graded.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    paired = keep(graded.join(several.drop("_n"), [*by, "bucket"], "left_semi"))
    featured = keep(race_features(paired, frames, by))
    group = [*by, "bucket"]
    return {
        "races": graded,
        "records": personal_records(races, by),
        "rejects": reject_counts(classified.where(F.coalesce(F.col("reject_reason"), F.lit("")) != "not_a_race"), by),
        "features": featured,
        "contrast": contrast(featured, group, RACE_FEATURES),
        "correlations": feature_correlations(featured, RACE_FEATURES, "pace", group),
    }
