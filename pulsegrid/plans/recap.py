"""Recap of each entity's latest run against its own history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import drift_label, fmt_speed_pace, fmt_time, note_flags, safe_div, versus_label
from ..operators.aggregates import baseline_aggregates, baseline_window, extremes
from ..operators.clean import clean_daily, prefer_rows
from ..operators.ranges import similar_runs
from ..operators.steady import drift_from_details, mark_steady, run_ce, runs_with_ce
from ..operators.windows import last_n
from ..session import keep
from .features import order_of
from .fitness import running
from .readiness import FACTOR_COLS, score_factors, with_day

MIN_DRIFT_M = 5000.0
MIN_SIMILAR_RUNS = 3
MIN_SPLIT_M = 100.0


def latest_run(acts: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """The newest running activity of each entity with its headline numbers."""
    last = last_n(running(acts), by, ["start_time_local", "activity_id"], 1)
    speed = F.coalesce(safe_div(F.coalesce(F.col("distance_m"), F.lit(0.0)), F.col("duration_sec")), F.lit(0.0))
    return last.withColumns(
        {
            "distance_km": F.coalesce(F.col("distance_m"), F.lit(0.0)) / 1000.0,
            "pace_text": fmt_speed_pace(speed),
            "duration_text": fmt_time(F.coalesce(F.col("duration_sec"), F.lit(0.0))),
        }
    )


def ce_context(latest: DataFrame, runs: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Efficiency of the latest run, its 28-day comparison and all-time percentile.

    One aggregation over the entity's runs, each joined with the single latest one.
    """
    by = list(by)
    mine = latest.select(*by, F.col("activity_id").alias("_id"), F.col("date").alias("_day")).join(
        runs.select(*by, F.col("activity_id").alias("_id"), F.col("ce").alias("this_ce"), F.col("gap_speed").alias("this_gap"), F.col("avg_hr").alias("this_hr"), F.col("avg_temp").alias("this_temp"), (F.col("avg_cadence") * 2.0).alias("this_cadence_spm"), F.col("avg_stride").alias("this_stride"), F.col("avg_gct").alias("this_gct")),
        [*by, "_id"],
    )
    recent = (F.col("date") > F.date_sub("_day", 28)) & (F.col("activity_id") != F.col("_id"))
    context = (
        runs.select(*by, "activity_id", "date", "ce")
        .join(mine.select(*by, "_id", "_day", "this_ce"), by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.avg(F.when(recent, F.col("ce"))).alias("avg_28d"),
            stats.percentile_of(F.col("ce"), F.col("this_ce")).alias("percentile"),
        )
    )
    out = mine.join(context, by)
    pct = F.try_divide(F.col("this_ce") - F.col("avg_28d"), F.col("avg_28d")) * 100.0
    return (
        out.withColumn("vs_28d_pct", pct)
        .withColumns(
            {
                "vs_28d": versus_label(F.col("vs_28d_pct")),
                "percentile": F.when(F.col("runs") > 1, F.col("percentile")),
            }
        )
        .withColumnRenamed("_id", "activity_id")
        .drop("_day")
    )


def similar_comparison(latest: DataFrame, runs: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Latest run against runs of similar length in the last 90 days (at least three)."""
    by = list(by)
    near = similar_runs(runs, latest, by)
    means = near.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_similar"),
        F.avg("ce").alias("similar_ce"),
        F.avg("gap_speed").alias("similar_gap"),
        F.avg("avg_hr").alias("similar_hr"),
    )
    ends = extremes(near, by, "ce", "date", ["date", "activity_id"])
    mine = latest.select(*by, "activity_id").join(runs.select(*by, "activity_id", "ce"), [*by, "activity_id"])
    pct = (F.col("ce") - F.col("similar_ce")) / F.col("similar_ce") * 100.0
    return (
        mine.join(means.where(F.col("n_similar") >= MIN_SIMILAR_RUNS), by)
        .join(ends, by)
        .withColumn("vs_similar_pct", pct)
        .withColumn("vs_similar", versus_label(F.col("vs_similar_pct")))
    )


def recap_splits(splits: DataFrame, activities: DataFrame) -> DataFrame:
    """Splits of the given activities: interval splits if there are any, else all; remnants left out."""
    mine = splits.join(activities.select("activity_id"), "activity_id", "left_semi")
    chosen = prefer_rows(mine, ["activity_id"], F.col("split_type") == "INTERVAL")
    speed = F.coalesce(safe_div(F.col("distance_m"), F.col("duration_sec")), F.lit(0.0))
    return chosen.where(F.col("distance_m") >= MIN_SPLIT_M).withColumn("pace_text", fmt_speed_pace(speed))


def recovery_context(latest: DataFrame, daily: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Run-day factors against the 90 days before it (the day itself excluded)."""
    by = list(by)
    day = latest.select(*by, F.col("date").alias("_run_day"))
    around = daily.join(day, by)
    that_day = F.when(F.col("date") == F.col("_run_day"), F.col("date"))
    before = baseline_window(F.col("_run_day"), include_day=False)
    entity = around.groupBy(*by).agg(
        F.max_by(F.struct("date", *FACTOR_COLS), that_day).alias("_t"), *baseline_aggregates(FACTOR_COLS, before)
    )
    return score_factors(with_day(entity, by, "date")).where(F.col("factors") > 0)


def recap_report(frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",)) -> dict[str, DataFrame]:
    by = list(by)
    latest = keep(latest_run(frames["activities"], by))
    acts = running(frames["activities"]).select(*by, "activity_id", "date", "start_time_local", "distance_m", "duration_sec")
    runs = keep(runs_with_ce(acts, run_ce(mark_steady(frames["activity_details"]))))
    context = ce_context(latest, runs, by)

    long_enough = latest.where(F.col("distance_m") >= MIN_DRIFT_M)
    drift = drift_from_details(frames["activity_details"].join(long_enough.select("activity_id"), "activity_id", "left_semi")).select("activity_id", "decoupling_pct", "hr_drift_pct", "hr_h1", "hr_h2", "skip_reason")
    drift = drift.withColumn("drift_label", drift_label(F.col("decoupling_pct")))

    summary = latest.join(context, [*by, "activity_id"], "left").join(drift, "activity_id", "left")
    summary = summary.withColumns(note_flags(F.col("vs_28d_pct"), F.col("decoupling_pct"), F.col("training_effect")))
    raw = frames["daily_health"]
    out = {
        "summary": summary,
        "similar": similar_comparison(latest, runs, by),
        "recovery": recovery_context(latest, clean_daily(raw, by, order_of(raw, ["ingest_seq"])), by),
    }
    if frames.get("activity_splits") is not None:
        out["splits"] = recap_splits(frames["activity_splits"], latest)
    return out
