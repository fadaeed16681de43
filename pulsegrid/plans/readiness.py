"""Readiness: today's recovery factors against the personal baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import outlook, readiness_label, readiness_score, recommendation, z_status, zscore
from ..operators.aggregates import baseline_aggregates, baseline_window, floor_rank_quantile, trailing_volumes
from ..operators.clean import clean_daily
from ..operators.joins import health_on_day
from ..operators.ranges import similar_days
from ..session import keep
from .features import order_of
from .fitness import efficiency_runs, running

# Factor column and direction (1: higher is better)
FACTORS = [
    ("resting_hr", -1.0),
    ("sleep_seconds", 1.0),
    ("sleep_score", 1.0),
    ("hrv_last_night", 1.0),
    ("avg_stress", -1.0),
    ("body_battery_start", 1.0),
]
FACTOR_COLS = [c for c, _ in FACTORS]
SIMILAR_BAND = 0.5
MIN_SIMILAR = 5


def mean_of_present(cols: Sequence[Column]) -> tuple[Column, Column]:
    """Mean and count of the non-null values among several columns."""
    count = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(count > 0, total / count), count


def score_factors(df: DataFrame) -> DataFrame:
    """Add ``z_<factor>``, their mean, the 1..10 score and label.

    ``df`` carries each factor with its ``_mean`` and ``_std``.
    """
    df = df.withColumns(
        {f"z_{c}": zscore(F.col(c).cast("double"), F.col(f"{c}_mean"), F.col(f"{c}_std"), s) for c, s in FACTORS}
    )
    mean_z, n = mean_of_present([F.col(f"z_{c}") for c in FACTOR_COLS])
    return (
        df.withColumns({"mean_z": mean_z, "factors": n})
        .withColumn("score", readiness_score(F.col("mean_z")))
        .withColumns(
            {
                "label": readiness_label(F.col("score")),
                **{f"status_{c}": z_status(F.col(f"z_{c}")) for c in FACTOR_COLS},
            }
        )
    )


def assess(daily: DataFrame, as_of: Column, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """One scored row per entity: the day itself, or the day before when it has no resting rate yet.

    The baseline covers the 90 days up to and including the assessed day.
    """
    by = list(by)
    age = F.datediff(as_of, F.col("date"))
    usable = (age == 1) | ((age == 0) & F.col("resting_hr").isNotNull())
    day = F.max_by(F.struct("date", *FACTOR_COLS), F.when(usable, F.col("date")))
    inside = baseline_window(as_of)
    entity = daily.where(inside).groupBy(*by).agg(day.alias("_t"), *baseline_aggregates(FACTOR_COLS, inside))
    return keep(score_factors(with_day(entity, by, "assessed_on")).where(F.col("factors") > 0))


def with_day(entity: DataFrame, by: Sequence[str], day_name: str) -> DataFrame:
    """Spread the assessed day's struct ``_t`` next to the baseline columns."""
    stats = [c for c in entity.columns if c not in by and c != "_t"]
    return entity.where(F.col("_t").isNotNull()).select(
        *by, F.col("_t.date").alias(day_name), *[F.col(f"_t.{c}").alias(c) for c in FACTOR_COLS], *stats
    )


def historical_days(
    runs: DataFrame, daily: DataFrame, today: DataFrame, by: Sequence[str] = ("profile_id",), min_factors: int = 2
) -> DataFrame:
    """Mean z of each past run's day, over the factors available today with real spread."""
    by = list(by)
    base = today.select(
        *by, *[c for f in FACTOR_COLS for c in (f"{f}_mean", f"{f}_std")], *[F.col(f"z_{f}").alias(f"_today_{f}") for f in FACTOR_COLS]
    )
    joined = health_on_day(runs.select(*by, "activity_id", "date", "ce"), daily.select(*by, "date", *FACTOR_COLS), by).join(base, by)
    zs = []
    for c, sign in FACTORS:
        usable = F.col(f"_today_{c}").isNotNull() & (F.col(f"{c}_std") > 0.001)
        zs.append(F.when(usable, (F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std") * F.lit(sign)))
    mean_z, n = mean_of_present(zs)
    return keep(joined.withColumns({"mean_z": mean_z, "_n": n}).where(F.col("_n") >= min_factors).select(*by, "activity_id", "date", "ce", "mean_z"))


def expected_ce(history: DataFrame, today: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Efficiency on similar days (at least five) against the overall mean."""
    by = list(by)
    overall = history.groupBy(*by).agg(F.avg("ce").alias("overall_ce"), F.count(F.lit(1)).alias("history"))
    near = similar_days(history, today.select(*by, F.col("mean_z").alias("today_z")), by, SIMILAR_BAND)
    stats = near.groupBy(*by).agg(F.avg("ce").alias("similar_ce"), F.count(F.lit(1)).alias("n_similar"))
    spread = floor_rank_quantile(near, by, "ce", {"p25": 0.25, "p75": 0.75})
    out = overall.join(stats, by, "left").join(spread, by, "left").fillna(0, ["n_similar"])
    enough = F.col("n_similar") >= MIN_SIMILAR
    return out.withColumns(
        {
            **{c: F.when(enough, F.col(c)) for c in ("similar_ce", "p25", "p75")},
            "outlook": F.when(enough, outlook(F.col("similar_ce"), F.col("overall_ce"))),
        }
    )


def readiness_report(
    frames: Mapping[str, DataFrame], as_of: Column, by: Sequence[str] = ("profile_id",)
) -> dict[str, DataFrame]:
    """All outputs look at days and activities up to ``as_of`` only."""
    by = list(by)
    raw = frames["daily_health"].where(F.col("date") <= as_of)
    frames = {**frames, "activities": frames["activities"].where(F.col("date") <= as_of)}
    daily = clean_daily(raw, by, order_of(raw, ["ingest_seq"]))
    today = assess(daily, as_of, by)
    acts = running(frames["activities"]).withColumn("distance_km", F.coalesce(F.col("distance_m"), F.lit(0.0)) / 1000.0)
    volumes = trailing_volumes(acts, by, as_of)
    summary = today.join(volumes.select(*by, "km_7d", "runs_7d", "vol_28d", "days_off"), by, "left").fillna(
        0, ["km_7d", "runs_7d", "vol_28d", "days_off"]
    )
    summary = summary.withColumn("recommendation", recommendation(F.col("score"), F.col("days_off")))
    out = {"factors": today, "summary": summary}
    if frames.get("activity_details") is not None:
        history = historical_days(efficiency_runs(frames, by), daily, today, by)
        out["history"] = history
        out["expected"] = expected_ce(history, today, by)
    return out
