"""Cardiac efficiency over time, cardiac drift and the numbers of a week plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import (
    RUNNING_TYPES,
    acwr_label,
    acwr_regime,
    ce_marker,
    drift_label,
    fmt_speed_pace,
    safe_div,
    scale_0_20,
    trend_label,
    type_in,
)
from ..operators.aggregates import (
    band_means,
    floor_rank_quantile,
    monthly_volume,
    recovery_means,
    trailing_volumes,
    volume_percentile,
    weekly_history,
    weekly_history_stats,
)
from ..operators.clean import clean_daily, plausible_runs
from ..operators.steady import drift_samples, mark_steady, run_ce, run_drift, runs_with_ce
from ..operators.windows import last_n, rolling_mean_rows, row_positions
from ..session import durable, keep
from .features import order_of

# Fixed values
RUN_ORDER = ["date", "start_time_local", "activity_id"]
RECENT_RUNS = 10
DRIVERS = [
    ("stride", "avg_stride"),
    ("ground_contact", "avg_gct"),
    ("cadence", "avg_cadence"),
    ("temperature", "avg_temp"),
    ("distance", "distance_km"),
]
DISTANCE_BANDS = [(5.0, 8.0, "5-8"), (8.0, 12.0, "8-12"), (12.0, 18.0, "12-18"), (18.0, 30.0, "18-30"), (30.0, 100.0, "30+")]
TEMPERATURE_BANDS = [(0.0, 18.0, "cool"), (18.0, 24.0, "mild"), (24.0, 30.0, "warm"), (30.0, 50.0, "hot")]
EASY_KM_DEFAULT = 8.0


def running(acts: DataFrame) -> DataFrame:
    return acts.where(type_in(RUNNING_TYPES))


def efficiency_runs(frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Run-level cardiac efficiency of every running activity with enough samples."""
    acts = running(frames["activities"]).select(*by, "activity_id", "date", "start_time_local", "distance_m", "duration_sec")
    return keep(runs_with_ce(acts, run_ce(mark_steady(frames["activity_details"]))))


def rolling_peak(runs: DataFrame, by: Sequence[str], n: int = RECENT_RUNS) -> DataFrame:
    """Best full ``n``-run mean and its date (first on ties); 0.0 and the first run's date below n runs."""
    placed = row_positions(runs, by, F.col("date"), RUN_ORDER, "_pos")
    rolled = rolling_mean_rows(placed, by, "_pos", "ce", n, "_avg")
    return rolled.groupBy(*by).agg(
        F.coalesce(F.max("_avg"), F.lit(0.0)).alias("peak_ce"),
        F.coalesce(
            F.max_by("date", F.when(F.col("_avg").isNotNull(), F.struct(F.col("_avg"), -F.col("_pos")))), F.min("date")
        ).alias("peak_date"),
    )


def anchored(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs with their entity's last run date as ``anchor`` (a written table, so that a hot entity's runs can be split)."""
    return runs.join(durable(runs.groupBy(*by).agg(F.max("date").alias("anchor"))), list(by))


def trend(runs: DataFrame, by: Sequence[str], days: int = 28) -> DataFrame:
    """Mean of the last and of the previous ``days`` before each anchor, and their difference."""
    age = F.datediff("anchor", "date")
    now = F.avg(F.when(age < days, F.col("ce")))
    before = F.avg(F.when((age >= days) & (age < 2 * days), F.col("ce")))
    return runs.groupBy(*by).agg(
        F.max("anchor").alias("anchor"),
        F.count(F.lit(1)).alias("runs"),
        F.avg("ce").alias("mean_ce"),
        now.alias("ce_28d"),
        before.alias("ce_prev_28d"),
        (now - before).alias("trend"),
        trend_label(now - before).alias("trend_label"),
    )


def current_state(runs: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Latest form per entity: ten-run mean and its percentile, 28-day mean, trend, peak.

    The percentile belongs to the ten-run mean, not to the 28-day mean.
    """
    by = list(by)
    recent = durable(last_n(runs, by, RUN_ORDER, RECENT_RUNS).groupBy(*by).agg(F.avg("ce").alias("current_ce")))
    rank = (
        runs.select(*by, "ce").join(recent, by).groupBy(*by).agg(stats.percentile_of(F.col("ce"), F.col("current_ce")).alias("percentile"))
    )
    return trend(anchored(runs, by), by).join(recent, by).join(rank, by).join(rolling_peak(runs, by), by)


def recent_runs(runs: DataFrame, by: Sequence[str], n: int = RECENT_RUNS) -> DataFrame:
    mean = runs.groupBy(*by).agg(F.avg("ce").alias("mean_ce"))
    shown = last_n(runs, by, RUN_ORDER, n)
    return shown.join(mean, list(by)).withColumns(
        {"marker": ce_marker(F.col("ce"), F.col("mean_ce")), "gap_pace": fmt_speed_pace(F.col("gap_speed"))}
    )


def monthly_trend(runs: DataFrame, by: Sequence[str], days: int = 365) -> DataFrame:
    """Monthly mean over the year before the anchor, with a 0..20 bar position."""
    months = (
        anchored(runs, by)
        .where(F.datediff("anchor", "date") < days)
        .groupBy(*by, F.trunc("date", "month").alias("month"))
        .agg(F.avg("ce").alias("ce"), F.count(F.lit(1)).alias("runs"))
    )
    span = months.groupBy(*by).agg(F.min("ce").alias("_lo"), F.max("ce").alias("_hi"))
    return months.join(span, list(by)).withColumn("bar", scale_0_20(F.col("ce"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def ce_drivers(runs: DataFrame, by: Sequence[str], min_pairs: int = 20) -> DataFrame:
    """Correlation of cardiac efficiency with run dynamics, only above ``min_pairs`` pairs."""
    pairs = F.array(*[F.struct(F.lit(n).alias("driver"), F.col(c).cast("double").alias("x")) for n, c in DRIVERS])
    return (
        runs.select(*by, "ce", F.inline(pairs))
        .groupBy(*by, "driver")
        .agg(stats.pair_count(F.col("ce"), F.col("x")).alias("n"), stats.corr_or_zero(F.col("ce"), F.col("x")).alias("r"))
        .where(F.col("n") > min_pairs)
    )


def volumes(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trailing volumes before each anchor, the monthly percentile and the load ratio."""
    now = keep(trailing_volumes(anchored(runs, by), by, F.col("anchor")).drop("days_off", "last_run"))
    pct = volume_percentile(monthly_volume(runs, by), now, by)
    ratio = safe_div(F.col("vol_28d"), F.col("vol_prev_28d"))
    return now.join(pct, list(by)).withColumns({"load_ratio": ratio, "load_label": acwr_label(ratio)})


def week_plan(
    runs: DataFrame, by: Sequence[str], as_of: Column, recovery: DataFrame | None = None
) -> DataFrame:
    """Numbers and flags of the week plan from the runs up to ``as_of``; one row per entity with an earlier 28-day volume."""
    by = list(by)
    runs = runs.where(F.col("date") <= as_of)
    monday = F.date_trunc("week", as_of).cast("date")
    vols = volumes(runs, by).where(F.col("vol_prev_28d") > 0)
    week = runs.groupBy(*by).agg(
        F.count_if((F.col("date") >= monday) & (F.col("date") <= as_of)).alias("runs_this_week"),
        F.coalesce(F.sum(F.when((F.col("date") >= monday) & (F.col("date") <= as_of), F.col("distance_km"))), F.lit(0.0)).alias("km_this_week"),
    )
    last90 = keep(anchored(runs, by).where(F.datediff("anchor", "date") < 90).select(*by, "anchor", "date", "distance_km", "gap_speed"))
    easy = floor_rank_quantile(last90, by, "distance_km", {"typical_easy": 0.5})
    hist = weekly_history_stats(weekly_history(runs, by, as_of), by)
    gap = last90.where(F.datediff("anchor", "date") < 28).groupBy(*by).agg(
        (F.max("gap_speed") > F.avg("gap_speed") * 1.08).alias("has_quality")
    )
    out = vols.join(week, by).join(easy, by, "left").join(hist, by).join(gap, by, "left")
    if recovery is not None:
        out = out.join(recovery, by, "left")
    else:
        none = F.lit(None).cast("double")
        out = out.withColumns({"recovery_stress": none, "recovery_hrv": none, "recovery_sleep_hours": none})

    typical = F.coalesce(F.col("typical_easy"), F.lit(EASY_KM_DEFAULT))
    days_left = F.lit(6) - F.weekday(as_of)
    prev, now = F.col("vol_prev_28d"), F.col("vol_28d")
    out = out.withColumns(
        {
            "typical_easy": typical,
            "days_left": days_left,
            "regime": acwr_regime(F.col("load_ratio")),
            "target_vol": prev * 0.85,
            "vol_gap": F.greatest(prev * 0.85 - now, F.lit(0.0)),
            "safe_cap": F.col("recent_max_km") * 1.10,
            "already_above_avg": F.col("km_this_week") > F.col("avg_weekly_km") * 1.05,
            "recovery_favorable": F.coalesce(F.col("recovery_stress") < 35.0, F.lit(True))
            & F.coalesce(F.col("recovery_hrv") > 20.0, F.lit(True))
            & F.coalesce(F.col("recovery_sleep_hours") > 7.0, F.lit(True)),
        }
    ).withColumn("remaining_budget", F.greatest(F.col("safe_cap") - F.col("km_this_week"), F.lit(0.0)))

    budget, typical = F.col("remaining_budget"), F.col("typical_easy")
    low, high = F.col("regime") == "detraining", F.col("regime") == "overtraining"
    fits = F.floor(F.try_divide(budget, typical))
    n_easy = F.greatest(F.least(fits, F.floor((F.col("days_left") + 1) / 2)), F.lit(1))
    room = low & (budget >= typical * 0.5)
    long_target = F.when(F.col("long_run_28d") > typical * 1.2, F.round(F.col("long_run_28d") * 1.10)).otherwise(
        F.round(typical * 1.5)
    )
    scenario_b = room & (F.col("days_left") >= 3) & (long_target <= budget)
    n_easy_b = F.least(F.floor(F.try_divide(budget - long_target, typical)), F.greatest(F.col("days_left") - 1, F.lit(0)))
    vol_a, vol_b = typical * n_easy, typical * n_easy_b + long_target
    best_ratio = (now + F.least(budget, typical * 3.0)) / prev
    return out.withColumns(
        {
            "near_cap": low & (budget < typical * 0.5),
            "short_run_km": F.when(low & (budget < typical * 0.5) & ~F.col("already_above_avg"), F.greatest(F.round(budget), F.lit(3.0))),
            "n_easy_a": F.when(room, n_easy),
            "week_km_a": F.when(room, F.col("km_this_week") + vol_a),
            "ratio_a": F.when(room, (now + vol_a) / prev),
            "long_target_b": F.when(scenario_b, long_target),
            "n_easy_b": F.when(scenario_b, n_easy_b),
            "week_km_b": F.when(scenario_b, F.col("km_this_week") + vol_b),
            "ratio_b": F.when(scenario_b, (now + vol_b) / prev),
            "needs_quality": low & ~F.coalesce(F.col("has_quality"), F.lit(False)),
            "multi_week": low & ~F.col("already_above_avg") & (best_ratio < 0.80),
            "excess_km": F.when(high, F.greatest(now - prev * 1.2, F.lit(0.0))),
            "reduced_run_km": F.when(high, F.greatest(F.round(typical * 0.7), F.lit(3.0))),
            "reduced_runs": F.when(high, F.round(F.greatest(F.col("runs_per_week") - 1.0, F.lit(2.0))).cast("int")),
            "maintain_km": F.when(~low & ~high, now / 4.0),
        }
    )


def fitness_report(
    frames: Mapping[str, DataFrame], as_of: Column, by: Sequence[str] = ("profile_id",)
) -> dict[str, DataFrame]:
    """All outputs look at activities and days up to ``as_of`` only."""
    by = list(by)
    runs = efficiency_runs({**frames, "activities": frames["activities"].where(F.col("date") <= as_of)}, by)
    recovery = None
    if frames.get("daily_health") is not None:
        raw = frames["daily_health"]
        recovery = recovery_means(clean_daily(raw, by, order_of(raw, ["ingest_seq"])), by, as_of)
    return {
        "run_ce": runs,
        "state": current_state(runs, by),
        "recent": recent_runs(runs, by),
        "monthly": monthly_trend(runs, by),
        "volumes": volumes(runs, by),
        "recovery": recovery,
        "drivers": ce_drivers(runs, by),
        "plan": week_plan(runs, by, as_of, recovery),
    }


# ----------------------------------------------------------------------- drift
def drift_runs(
    frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",), above_m: float | None = 5000.0, min_m: float | None = None
) -> DataFrame:
    """Drift per running activity longer than 5 km, skipped ones with their reason."""
    acts = plausible_runs(running(frames["activities"]), min_distance_m=min_m, above_distance_m=above_m)
    acts = durable(acts.select(*by, "activity_id", "date", "start_time_local", (F.col("distance_m") / 1000.0).alias("distance_km")))
    samples = drift_samples(frames["activity_details"].join(acts.select("activity_id"), "activity_id", "left_semi"))
    drift = run_drift(samples, run_ce(samples))
    have = samples.select("activity_id").distinct()
    out = acts.join(have, "activity_id", "left_semi").join(drift, "activity_id", "left")
    # samples that do not pass the efficiency guards count as too short
    return keep(
        out.withColumn(
            "skip_reason",
            F.when(F.col("seconds_used").isNull(), F.lit("TooShort")).otherwise(F.col("skip_reason")),
        ).withColumn("label", drift_label(F.col("decoupling_pct")))
    )


def drift_report(frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",)) -> dict[str, DataFrame]:
    by = list(by)
    every = drift_runs(frames, by)
    runs = every.where(F.col("skip_reason").isNull())
    overall = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("decoupling_pct").alias("mean_decoupling"))
    median = floor_rank_quantile(runs, by, "decoupling_pct", {"median_decoupling": 0.5})
    # temperature bands are shown above 20 runs with a temperature
    warm = runs.where(F.col("avg_temp").isNotNull())
    enough = warm.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 20)
    recent = last_n(runs, by, RUN_ORDER, RECENT_RUNS)
    recent_avg = F.avg("decoupling_pct")
    bar = F.round(F.greatest(F.lit(0.0), F.least(F.lit(15.0), F.avg("decoupling_pct"))) / 15.0 * 20.0).cast("int")
    return {
        "runs": every,
        "skipped": every.where(F.col("skip_reason").isNotNull()).groupBy(*by, "skip_reason").agg(F.count(F.lit(1)).alias("n")),
        "overall": overall.join(median, by),
        "by_distance": band_means(runs, by, "distance_km", DISTANCE_BANDS, ["decoupling_pct", "hr_drift_pct"]),
        "by_temperature": band_means(warm.join(enough, by, "left_semi"), by, "avg_temp", TEMPERATURE_BANDS, ["decoupling_pct"]),
        "yearly": runs.groupBy(*by, F.year("date").alias("year")).agg(
            F.avg("decoupling_pct").alias("decoupling_pct"), F.count(F.lit(1)).alias("n"), bar.alias("bar")
        ),
        "recent": recent,
        "recent_level": recent.groupBy(*by).agg(
            recent_avg.alias("recent_decoupling"),
            F.when(recent_avg < 5.0, F.lit("solid")).when(recent_avg < 10.0, F.lit("normal")).otherwise(F.lit("elevated")).alias("level"),
        ),
    }
